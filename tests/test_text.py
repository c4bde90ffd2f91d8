"""Literals with known readings, and properties of the scanners."""

import random
import re
import time

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filmweave.functions import text as T, wikitext as W
from filmweave.operators import cast, tables


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(1,)], [*values] or ["x"])
    return row.select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("line", "want"), [("== Danh sách phim ==", (2, "Danh sách phim")), ("==== Truyền hình ====", (4, "Truyền hình")), ("một câu", None), ("== a =", None), ("====", None)])
def test_heading(spark, line, want):
    got = one(spark, T.heading("s"), s=line)
    assert (tuple(got) if got else None) == want


def test_ordered_distinct(spark):
    assert one(spark, F.array_distinct("s"), s=["Trấn Thành", "Ngô Thanh Vân", "Trấn Thành"]) == ["Trấn Thành", "Ngô Thanh Vân"]


def test_headers(spark):
    names = lambda text: one(spark, tables.headers(F.col("s")), s=text)
    two = '! rowspan="2" |Năm\n! rowspan="2" |Tựa đề\n! colspan="2" |Vai trò\n! rowspan="2" |Vai diễn\n! rowspan="2" |Ghi chú\n|-\n!Đạo diễn\n!Sản xuất'
    assert tuple(names(two)) == (["Năm", "Tựa đề", "Đạo diễn", "Sản xuất", "Vai diễn", "Ghi chú"], None)
    assert tuple(names("!Năm!!Tựa phim!!Vai diễn!!Ghi chú")) == (["Năm", "Tựa phim", "Vai diễn", "Ghi chú"], None)
    assert tuple(names("| không")) == ([], "fewer than two columns")
    assert names("! rowspan=2\n! b\n! c")["error"] == "a spanning header without text"


@pytest.mark.parametrize(("cell", "want"), [("[[Ngô Thanh Vân]] là [[đạo diễn]]", "Ngô Thanh Vân"), ("{{Không}}", "Không"), ("''ABC''", "ABC"), ("[[a|b]]", "a"), ("[[a [[b]]", "b"), ("{{t|[[x|y]]}}", "x"), ("[[u {{v|w}}|z]]", "u {{v|w}}"), ("<!--[[a]]-->{{b}}", "b"), ("[[x", "[[x"), ("", "")])
def test_cell(spark, cell, want):
    assert one(spark, tables.first_markup(F.col("s")), s=cell) == want


@pytest.mark.parametrize(
    ("token", "want"),
    [('rowspan="2" |phim truyền hình', (2, 1, "phim truyền hình")), ("2001", (1, 1, "2001")), ('rowspan="2" width="33" | a', (233, 1, "a")), ('rowspan="2" colspan="3"|a', (23, 23, "a")), ("rowspan|", (1, 1, "")), ("a | b", (1, 1, "a | b"))],
)
def test_span(spark, token, want):
    assert tuple(one(spark, T.span("s"), s=token)) == want


def test_double_pipe(spark):
    assert one(spark, tables.split_cells(F.col("s")), s="[[abc||cvd]]||abc||efd|b") == ["[[abc||cvd]]", "abc", "efd|b"]
    assert one(spark, tables.split_cells(F.col("s")), s="a||||{{b||[[c||d]]}} || [[open || e") == ["a", "", "{{b||[[c||d]]}}", "[[open || e"]
    assert one(spark, tables.first_pipe("s"), s="[[a|b]] {{c|d}} e|f") == 17
    assert one(spark, tables.first_pipe("s"), s="[[a|b]]") == -1


def test_cells_round_trip(spark):
    r = random.Random(4)
    rows = [[("".join(r.choices("ab |", k=r.randint(0, 5)))).replace("||", "|").strip().strip("|") for _ in range(r.randint(1, 6))] for _ in range(300)]
    got = spark.createDataFrame([(cells, " || ".join(cells)) for cells in rows], "cells array<string>, line string").select("cells", tables.split_cells(F.col("line")).alias("got")).collect()
    assert all(x["got"] == [c.strip() for c in x["cells"]] for x in got)


@given(st.text("a[]{}|=", max_size=40))
@settings(max_examples=300)
def test_parser_nests(s):
    nodes = W.parse(s)
    for n in nodes:
        assert s[n.start : n.start + 2] == n.kind and n.end > n.start
        assert "".join(n.parts(s)).count("") >= 1
    for a in nodes:
        for b in nodes:
            assert a is b or a.end <= b.start or b.end <= a.start or (a.start < b.start and b.end < a.end) or (b.start < a.start and a.end < b.end)


def laid_out(spark, width, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", tables.grid(F.col("s"), F.lit(width)).alias("g")).orderBy("i")
    return [r["g"] for r in rows.collect()]


def test_row_spans_cover_their_rows(spark):
    r, texts, wants = random.Random(5), [], []
    for _ in range(200):
        lines, want = ["{|"], []
        for _ in range(r.randint(1, 6)):
            n, v = r.randint(1, 3), "".join(r.choices("xyz", k=2))
            for k in range(n):
                lines += ["|-", (f'| rowspan="{n}" | {v} || {k}' if k == 0 else f"| {k}")]
                want.append([v, str(k)])
        texts.append("\n".join([*lines, "|}"]))
        wants.append(want)
    assert laid_out(spark, 2, *texts) == wants


def plain_grid(lines, width):
    """A grid laid out cell by cell: (rowspan, colspan, value) cells per row, what runs on from rows above first."""
    out, running = [], {}
    for cells in lines:
        row = [running[c][1] if c in running else None for c in range(width)]
        running = {c: (n - 1, v) for c, (n, v) in running.items() if n > 1}
        at, new = 0, {}
        for down, across, value in cells:
            while at < width and row[at] is not None:
                at += 1
            if at >= width:
                break
            row[at : at + across] = [value] * min(across, width - at)
            if down > 1:
                new[at] = (down - 1, value)
            at += across
        running = {**new, **running}
        out.append(row)
    return [r for r in out if any(x is not None for x in r)]


def test_grid_against_a_plain_one(spark):
    r, texts, wants = random.Random(6), [], []
    for _ in range(300):
        rows = [[(r.choice([1, 1, 2, 3]), r.choice([1, 1, 2]), f"v{r.randrange(99)}") for _ in range(r.randint(0, 4))] for _ in range(r.randint(1, 6))]
        written = [" || ".join(f'rowspan="{d}" | {v}' if a == 1 else f'colspan="{a}" | {v}' for d, a, v in row) for row in rows]
        texts.append("{|\n" + "\n".join("|-" + (f"\n| {w}" if w else "") for w in written) + "\n|}")
        wants.append(plain_grid([[(d if a == 1 else 1, a, v) for d, a, v in row] for row in rows], 4))
    assert laid_out(spark, 4, *texts) == wants


def test_tables_run_no_python(spark):
    rows = tables.table_rows(spark.createDataFrame([("a", 0, "s", "!x!!y\n|-\n|1||2")], "title string, section_no int, section string, wikitext string"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and [r["cells"] for r in rows.collect()] == [{"x": "1", "y": "2"}]


def test_grid_quirks(spark):
    assert laid_out(spark, 2, "{|\n|+ c\n|-\n|a||b||c\nlost\n|-\n|-\n|\n|}\n|x") == [[["+ c", None], ["a", "b"], ["", None]]]
    assert laid_out(spark, 3, '{|\n|-\n| colspan="2" | a || b\n|}') == [[["a", "a", "b"]]]


def test_links(spark):
    assert one(spark, T.wikilinks("s"), s='style="x" [[a|b]] c [[d]]') == ["[[a|b]]", "[[d]]"]


def test_row_cast(spark):
    row = "|''Vy''\n|[[Angela Phương Trinh]], [[Phạm Thị Ngọc Trinh|x]] | [[Hồng Ánh]]"
    assert [tuple(x) for x in one(spark, cast.row_cast(F.col("s")), s=row)] == [("Angela Phương Trinh", "Vy"), ("Phạm Thị Ngọc Trinh", "Vy"), ("Hồng Ánh", "Vy")]
    row = '|\'\'thiện\'\'| colspan="2" |[[Lương Thế Thành]]'
    assert [tuple(x) for x in one(spark, cast.row_cast(F.col("s")), s=row)] == [("Lương Thế Thành", "thiện")]


PROSE = "*\n[[Trần Nghĩa (diễn viên)|Trần Nghĩa]]\n vai Ngạn:\n<ref>{{Chú thích web|vai=x}}</ref> Chàng trai\n\n* Lan trong vai Hà, cô gái\n* không"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (PROSE, [("Trần Nghĩa diễn viên", "Ngạn"), ("Lan", "Hà")]),
        ("* [[A]] VAI 'B' \"c\". d", [("A", "B c")]),
        ("* Phim gồm [[A|x]] vai B", [("A", "B")]),
        ("* cùng Lê Văn Đ vai E", [("Lê Văn Đ", "E")]),
        ("* và Y vai Z<ref name=a/>, w", [("Y", "Z")]),
        ("* [[A]] vai C Cùng một số diễn viên khác", [("A", "C")]),
        ("* vai C", []),
        ("* [[A]] là B", []),
        ("x [[A]] vai B * [[C]] vai D", [("A", "B"), ("C", "D")]),
        ("", []),
    ],
)
def test_prose_cast(spark, text, want):
    assert [tuple(x) for x in one(spark, cast.prose_cast(F.col("s")), s=text)] == want


def test_prose_cast_keeps_parentheses(spark):
    assert [tuple(x) for x in one(spark, cast.prose_cast(F.col("s"), keep_parentheses=True), s=PROSE)][0] == ("Trần Nghĩa (diễn viên)", "Ngạn")


def test_list_cast(spark):
    text = "x {{cast list|\n* [[A|b]] vai ''C''\n* Lê D vai ''E''<ref>x</ref>\n* [[F]] vai G\n* {{x}} vai ''H''}} {{a|{{cast list|* [[N]] vai ''O''}}}}"
    assert [tuple(x) for x in one(spark, cast.list_cast(W.templates("s")), s=text)] == [("A", "C"), ("Lê D", "E"), ("F", None), (None, "H")]


@pytest.mark.parametrize(
    ("name", "want"), [("Hồng Ánh", True), ("Phim a", False), ("NHỎ a", False), ("1 2", False), ("--", False), ("a", False), ("a" * 81, False), ("có một", False), ("Ế", False), (None, False)]
)
def test_names(spark, name, want):
    assert spark.createDataFrame([(name,)], "s string").select(T.plausible_name("s")).first()[0] is want


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("{{birth date and age|1995|6|4}}", "1995-06-04"),
        ("{{năm sinh|1990}}", "1990"),
        ("{{marriage|[[A|B]]|cưới 2010}}", "B (2010)"),
        ("{{ubl|a|[[b]]}}", "a, b"),
        ("{{height|cm=170}} {{nor}}", "170m Na Uy"),
        ("{{small|x}}", "(x)"),
        ("{{Chú thích|a}}{{chú thích web|url=b}}", "url=b"),
        ("{{a|{{b|c}}", "{{a|c"),
        ("a<ref name=x/><br>b <!-- c -->[http://x y] [http://z]", "a, b y"),
        (", , a ,", "a"),
        (None, ""),
    ],
)
def test_clean_text(spark, text, want):
    assert spark.createDataFrame([(text,)], "s string").select(T.clean_text("s")).first()[0] == want


def test_scalars(spark):
    assert one(spark, T.convert(F.col("s")), s=["1,7 x", "km"]) == "1,7m"
    assert one(spark, T.height(F.col("s")), s=["ft=5", "cm=170"]) == "170m"
    assert one(spark, T.without_marks("s"), s=" 'a' ") == "a"
    assert one(spark, T.strip("s"), s="\n a  b\x1f") == "a  b"


def test_infobox_value():
    assert W.infobox_value("[[Hà Nội]], [[Việt Nam|VN]]") == "Hà Nội, VN"
    assert W.infobox_value("{{VIE}} {{flag|X}} {{birth date|1990|1|2}} {{hlist|a}} {{z}}'''b'''<br/>c&nbsp;<ref>q</ref>") == "Việt Nam X 1990-01-02 a b, c"


def naive(text, pattern, reads):
    """Innermost templates one at a time, searched anew after each."""
    while m := re.search(pattern, text):
        text = text[: m.start()] + reads(m.group()[2:-2]) + text[m.end() :]
    return text


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["{{", "}}", "{", "}", "|", "a", "b c", "cite", "vie", "{{x|"]), max_size=14).map("".join))
def test_fold_is_what_searching_anew_gives(text):
    assert W.fold(text) == naive(text, r"\{\{([^{}]+)\}\}", W.read_template)
    assert W.replace_innermost(text, str.upper, empty=True) == naive(text, r"\{\{[^{}]*\}\}", str.upper)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[[a|b|c]] [[d]] [[e|]]", "b|c d e"),
        ("[[a|x [[b|c]] y]]", "x c y"),
        ("[[a [[b|c|d]]|e]]", "d|e"),
        ("[[a {{t|[[b|c]]|d}}|e]]", "e"),
        ("{{t|[[b|c]]}} [[open", "{{t|c}} [[open"),
        ("{{t|[[b}} c]]", "{{t|[[b}} c]]"),
        ("<!--[[a|b]]-->[[c]]", "<!--[[a|b]]-->c"),
    ],
)
def test_labels(text, want):
    assert W.labels(text) == want


def test_folding_is_linear():
    """Ten thousand links and templates, side by side and one in the other."""
    many = "{{ubl|" + "".join(f"[[x{i}|y{i}]] {{{{small|{i}}}}} " for i in range(10_000)) + "}}"
    began = time.time()
    assert W.fold(many).count("(") == 10_000 and W.labels(many).count("[[") == 0 and W.infobox_value(many)
    assert W.fold("{{a|" * 10_000 + "x" + "}}" * 10_000) == "x" and W.labels("[[" * 10_000 + "x" + "]]" * 10_000) == "x"
    assert time.time() - began < 20
