"""Wikitables: headers, the cell grid, and film rows; all in column expressions.

Cells are read row by row; a grid is a fold over the rows whose state is places of
cells in numbers, not their texts, and the spans still open, so no table leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from filmweave.functions import text as T
from filmweave.operators import predicates, sections
from filmweave.staging import spread

STYLE = r"""style\s*=\s*["'].*?["']"""
#: Links and templates within each other that are seen as such; deeper ones are text.
DEPTH = 4
#: Stands for a top-level mark; no XML document holds it.
CUT = "\x01"


def _within(depth: int, kind: str, pipes: str = "", in_template: bool = False) -> str:
    """What may stand between the marks of a link or template; without ``pipes`` up to the first of its own."""
    own = {"[": rf"\](?!\])|\[(?!\[)|\{{(?!\{{)|\}}{r'(?!})' if in_template else ''}", "{": r"\[|\]|\{(?!\{)|\}(?!\})"}[kind]
    inner = "".join(f"{_node(depth - 1, k, kind == '{' or in_template)}|" for k in "[{") if depth else ""
    return rf"(?:[^\[\]{{}}{pipes}]++|{inner}{own})*+"


def _node(depth: int, kind: str, in_template: bool = False) -> str:
    a, b = (r"\[\[", r"\]\]") if kind == "[" else (r"\{\{", r"\}\}")
    return f"{a}{_within(depth, kind, '', in_template)}{b}"


def _first(kind: str) -> str:
    """A node whose first part is a group."""
    a, b = (r"\[\[", r"\]\]") if kind == "[" else (r"\{\{", r"\}\}")
    return rf"{a}({_within(DEPTH, kind, '|')})(?:\|{_within(DEPTH, kind)})?{b}"


LINK, TEMPLATE = _first("["), _first("{")
#: A run without a top-level pipe, and one without two; what opens and never closes takes the rest.
_UNITS = rf"[^|\[{{]++|{_node(DEPTH, '[')}|{_node(DEPTH, '{')}|\[\[[\s\S]*|\{{\{{[\s\S]*|\[|\{{"
NO_PIPE, NO_PIPES = rf"(?:{_UNITS})*+", rf"(?:{_UNITS}|\|(?!\|))*+"


def first_markup(text: Column) -> Column:
    """A table cell's reading: target of the first link, else name of the first template, else the text itself."""
    marked = text.contains("[[") | text.contains("{{") | text.contains("''") | text.contains("<")
    bare = F.when(text.contains("<"), F.regexp_replace(text, r"(?is)<!--.*?-->|<nowiki>.*?</nowiki>", "")).otherwise(text)
    found = lambda t, pattern, mark: F.when(t.contains(mark), F.get(F.regexp_extract_all(t, F.lit(pattern), F.lit(1)), 0))
    plain = F.replace(F.replace(text, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    return T.strip(F.when(~marked, text).otherwise(F.coalesce(T.let(bare, lambda t: F.coalesce(found(t, LINK, "[["), found(t, TEMPLATE, "{{"))), plain)))


def split_cells(line: Column) -> Column:
    """Stripped pieces between top-level ``||``."""
    nodes = line.contains("[[") | line.contains("{{")
    cut = F.when(nodes, F.regexp_replace(line, rf"\G({NO_PIPES})\|\|", f"$1{CUT}")).otherwise(F.replace(line, F.lit("||"), F.lit(CUT)))
    return F.when(line.contains("||"), F.transform(F.split(cut, CUT), lambda p: T.strip(p))).otherwise(F.array(T.strip(line)))


def first_pipe(text: Column | str) -> Column:
    """Where the first top-level pipe stands, -1 if there is none."""
    text = T.col(text)
    return T.let(F.regexp_extract_all(text, F.lit(rf"\A({NO_PIPE})\|"), F.lit(1)), lambda found: F.when(text.isNotNull(), F.coalesce(F.length(F.get(found, 0)), F.lit(-1))))


def headers(table: Column) -> Column:
    """struct(names, error): column names; under a spanning header its children take the place of the first one."""
    unstyled = F.when(table.contains("style"), F.regexp_replace(table, STYLE, "")).otherwise(table)
    lines = F.filter(F.split(unstyled, "\n"), lambda x: x.contains("!"))
    none = F.array().cast("array<string>")

    def spanning(rows: Column) -> Column:
        bare = F.transform(rows, lambda r: T.strip(F.replace(r, F.lit("!"), F.lit(""))))

        def told(bare: Column) -> Column:
            second = lambda r: T.strip(F.get(F.split(r, r"\|"), 1))
            own = F.flatten(F.transform(bare, lambda r: F.when(r.startswith("rowspan"), F.array(second(r))).when(r.startswith("colspan"), F.array(F.lit("#"))).otherwise(none)))
            children = F.filter(bare, lambda r: ~r.startswith("rowspan") & ~r.startswith("colspan"))
            put = lambda n, at: F.when(at > 0, F.concat(F.slice(n, F.lit(1), at - 1), children, F.slice(n, at + 1, F.size(n)))).otherwise(n)
            names = T.let(own, lambda n: T.let(F.array_position(n, "#").cast("int"), lambda at: put(n, at)))
            return F.struct(names.alias("names"), F.when(F.exists(bare, lambda r: r.startswith("rowspan") & ~r.contains("|")), "a spanning header without text").alias("error"))

        return T.let(bare, told)

    def read(rows: Column) -> Column:
        flat = F.struct(F.flatten(F.transform(rows, lambda r: F.split(F.substring(r, F.lit(2), F.length(r)), "!!"))).alias("names"), F.lit(None).cast("string").alias("error"))
        return F.when(F.size(rows) == 0, F.struct(none.alias("names"), F.lit(None).cast("string").alias("error"))).when(F.get(rows, 0).contains("rowspan"), spanning(rows)).otherwise(flat)

    few = lambda h: F.when(F.size(h["names"]) < 2, "fewer than two columns")
    found = T.let(F.filter(F.transform(lines, lambda x: T.strip(x)), lambda r: r.startswith("!")), read)
    return T.let(found, lambda h: F.struct(h["names"].alias("names"), F.coalesce(h["error"], few(h)).alias("error")))


#: Places of cells: the row's number in the high half, the cell's in the low one.
_HALF = 32
_RUNNING = "array<struct<c:int,left:int,ref:bigint>>"


def row_cells(table: Column) -> Column:
    """The cells (down, across, v) of each row of the first table of a text; a row opens at a mark, the first also without one."""
    cell = lambda c: T.let(T.span_of(c), lambda s: F.struct(s["rowspan"].alias("down"), s["colspan"].alias("across"), first_markup(s["data"]).alias("v")))
    body = lambda x: F.transform(split_cells(F.substring(x, F.lit(2), F.length(x))), cell)
    places = lambda lines, found: F.filter(F.transform(lines, lambda x, i: F.when(found(x), i)), lambda i: i.isNotNull())

    def until_end(lines: Column) -> Column:
        end = F.get(places(lines, lambda x: (x == "}") | x.startswith("|}")), 0)
        return T.let(end, lambda e: F.when(e.isNull(), lines).otherwise(F.slice(lines, F.lit(1), F.coalesce(e, F.lit(0)))))

    def rows(lines: Column) -> Column:
        marks = places(lines, lambda x: x.startswith("|-"))
        unmarked = F.coalesce(~F.get(lines, 0).startswith("|-"), F.lit(False))
        starts = F.when(unmarked, F.concat(F.array(F.lit(-1)), marks)).otherwise(marks)
        held = lambda at, s, k: F.slice(lines, s + 2, F.coalesce(F.get(at, k + 1), F.size(lines)) - s - 1)
        return T.let(starts, lambda at: F.transform(at, lambda s, k: F.flatten(F.transform(held(at, s, k), body))))

    stripped = F.transform(F.filter(F.split(table, "\n"), lambda x: x.contains("|") | x.contains("}")), lambda x: T.strip(x))
    lines = T.let(F.filter(stripped, lambda x: x.startswith("|") | (x == "}")), until_end)
    return T.let(lines, rows)


def grid(table: Column, width: Column) -> Column:
    """Rows of the first table of a text, cells under row spans filled in; rows without any cell are dropped.

    Cells go to free columns from the left; a wide cell covers what follows, what doesn't fit is lost.
    """
    rows = T.let(row_cells(table), lambda r: T.let(F.sequence(F.lit(0), width - 1), lambda places: laid_out(r, width, places)))
    return F.filter(rows, lambda r: F.exists(r, lambda x: x.isNotNull()))


def laid_out(rows: Column, width: Column, places: Column) -> Column:
    """Texts by column of ``rows`` of cells; ``places`` are the numbers of the ``width`` columns."""
    no_spans = F.array().cast(_RUNNING)
    span = lambda c, cell: F.struct(c.alias("c"), (cell["down"] - 1).alias("left"), cell["ref"].alias("ref"))
    filled = lambda row, spans: F.struct(row.alias("row"), spans.alias("spans"))

    def narrow(fresh: Column, cells: Column) -> Column:
        """Cells of one column each go to the free ones in order."""

        def put(free: Column) -> Column:
            row = F.transform(places, lambda c: F.coalesce(F.get(fresh, c), F.get(cells, F.array_position(free, c).cast("int") - 1)["ref"]))
            spans = F.filter(F.transform(cells, lambda x, j: span(F.get(free, j), x)), lambda x: x["c"].isNotNull() & (x["left"] > 0))
            return filled(row, F.when(F.exists(cells, lambda x: x["down"] > 1), spans).otherwise(no_spans))

        return T.let(F.filter(places, lambda c: F.get(fresh, c).isNull()), put)

    def wide(fresh: Column, cells: Column) -> Column:
        def put(into: Column, cell: Column) -> Column:
            state = lambda row, at, spans: F.struct(row.alias("row"), at.alias("at"), spans.alias("spans"))

            def at(c: Column) -> Column:
                row = F.transform(into["row"], lambda x, i: F.when((i >= c) & (i < c + cell["across"]), cell["ref"]).otherwise(x))
                spans = F.when(cell["down"] > 1, F.concat(into["spans"], F.array(span(c, cell)))).otherwise(into["spans"])
                return F.when(c.isNotNull(), state(row, c + cell["across"], spans)).otherwise(state(into["row"], width, into["spans"]))

            return T.let(F.get(F.filter(places, lambda c: (c >= into["at"]) & F.get(into["row"], c).isNull()), 0), at)

        start = F.struct(fresh.alias("row"), F.lit(0).alias("at"), no_spans.alias("spans"))
        return F.aggregate(cells, start, put, lambda x: filled(x["row"], x["spans"]))

    def step(s: Column, cells: Column) -> Column:
        none = F.size(s["running"]) == 0
        under = F.transform(places, lambda c: F.get(F.filter(s["running"], lambda r: r["c"] == c), 0)["ref"])
        left = F.filter(F.transform(s["running"], lambda r: F.struct(r["c"].alias("c"), (r["left"] - 1).alias("left"), r["ref"].alias("ref"))), lambda r: r["left"] > 0)
        row = T.let(F.when(none, F.array_repeat(F.lit(None).cast("bigint"), width)).otherwise(under), lambda f: F.when(F.exists(cells, lambda x: x["across"] != 1), wide(f, cells)).otherwise(narrow(f, cells)))
        return T.let(row, lambda x: F.struct(F.concat(s["done"], x["row"]).alias("done"), F.when(none, x["spans"]).otherwise(F.concat(left, x["spans"])).alias("running")))

    numbered = F.transform(rows, lambda row, r: F.transform(row, lambda x, i: F.struct(x["down"].alias("down"), x["across"].alias("across"), (F.shiftleft(r.cast("bigint"), _HALF) + i).alias("ref"))))
    start = F.struct(F.array().cast("array<bigint>").alias("done"), no_spans.alias("running"))
    text = lambda ref: F.get(F.get(rows, F.shiftright(ref, _HALF).cast("int")), ref.bitwiseAND(F.lit((1 << _HALF) - 1)).cast("int"))["v"]
    told = lambda done: F.transform(rows, lambda _, r: F.transform(F.slice(done, r * width + 1, width), text))
    return T.let(F.aggregate(numbered, start, step)["done"], told)


def table_rows(parts: DataFrame) -> DataFrame:
    """(title, section_no, section, row_no, headers, cells, second, error): one row per table row of ``parts`` (title,
    section_no, section, wikitext), in order, with its second column's value. Other columns of ``parts`` come along.

    A table that can't be read gives one row with ``error``.
    """
    more = [c for c in parts.columns if c not in ("title", "section_no", "section", "wikitext")]
    read = parts.select("title", "section_no", "section", "wikitext", *more, headers(F.col("wikitext")).alias("_h"))
    fine = F.col("_h.error").isNull()
    rows = read.select("title", "section_no", "section", *more, "_h", F.posexplode_outer(F.when(fine, grid(F.col("wikitext"), F.size("_h.names")))).alias("row_no", "_row"))
    kept = rows.where(~fine | F.col("_row").isNotNull())
    return kept.select(
        "title", "section_no", "section", F.coalesce("row_no", F.lit(0)).alias("row_no"), F.when(fine, F.col("_h.names")).alias("headers"),
        F.when(fine, F.map_from_arrays("_h.names", "_row")).alias("cells"), F.get("_row", 1).alias("second"), F.col("_h.error").alias("error"), *more,
    )


def film_rows(film_parts: DataFrame) -> DataFrame:
    """Table rows of (title, film_part): sections that are tables; of sections with one title the last counts."""
    parts = film_parts.select("title", F.posexplode(sections.subsections(F.col("film_part"))).alias("section_no", "s")).select(
        "title", "section_no", F.col("s.title").alias("section"), F.col("s.subsection_wikitext").alias("wikitext")
    )
    last = parts.where(F.col("wikitext").startswith("{|")).groupBy("title", "section").agg(F.max_by(F.struct("section_no", "wikitext"), "section_no").alias("x"))
    return table_rows(spread(last.select("title", F.col("x.section_no").alias("section_no"), "section", F.col("x.wikitext").alias("wikitext")), "title"))


def vn_film_rows(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows whose second column names a film that counts as Vietnamese or may be; ``Type_film`` is the section.

    ``facts``: (title, vn_status), or what it is told from.
    """
    status = F.col("vn_status") if "vn_status" in facts.columns else predicates.vn_film_status(F.col("title"), F.col("kind"), F.col("infobox"))
    judged = facts.select(F.col("title").alias("_t"), status.alias("vn_status")).where(predicates.keeps_film(F.col("vn_status")))
    return rows.where("error is null").join(judged, F.col("second") == F.col("_t")).drop("_t").withColumn("type_film", F.col("section"))


def row_title(words: list[str]):
    """A film's title in a row: the usual columns, else the first whose name has one of ``words``; '' counts as missing."""
    usual = F.coalesce(*(F.nullif(F.try_element_at("cells", F.lit(k)), F.lit("")) for k in ("Tựa đề", "Tên phim")))
    named = F.get(F.filter("headers", lambda h: T.any_of(h, words)), 0)
    return F.coalesce(usual, F.nullif(F.try_element_at(F.col("cells"), named), F.lit("")))


#: Words of a title column when seeds are read, and when the network grows.
SEED_WORDS, GROWTH_WORDS = ["Tựa", "Tên", "Phim"], ["Tựa", "Tên"]
