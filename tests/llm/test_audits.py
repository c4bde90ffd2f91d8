"""Divergence audit, chat formatting and vector codes against plain versions."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from filmweave.llm import chat_format as C, divergence as D, vector_codes as V

# --- divergence -------------------------------------------------------------------------------------------------------


def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m.group().lower(), t) for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text or "")]


def plain_audit(rows, least, top):
    rows = [(lang or "", source or "", plain_terms(text)) for text, lang, source in rows]
    out = []
    for lang in {r[0] for r in rows}:
        mine = [(s, t) for la, s, t in rows if la == lang]
        docs, whole, by = Counter(), Counter(), defaultdict(Counter)
        for s, t in mine:
            docs.update(set(t))
            whole.update(t)
            by[s].update(t)
        kept = [t for t in docs if docs[t] >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(by[s]) for s in by}, share(whole)
        for s in by:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in by if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if by[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def spoken(seed, n=300):
    r = random.Random(seed)
    words = ["".join(r.choice("abcé") for _ in range(r.randint(1, 3))) for _ in range(60)]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 40))), r.choice(["en", "en", "de", None]), f"s{min(int(r.expovariate(0.3)), 12)}") for _ in range(n)]
    return rows + [(None, "en", "quiet"), ("", "xx", "alone"), ("12 3", "xx", None), ("Ärger ärger ÄRGER Über", "de", ""), ("abc " * 5000 + "É", "en", "s0"), ("a\x00b\x7fc퟿", "de", "s1")] + rows_alike()


def rows_alike():
    return [("same words twice", "en", "twin1"), ("same words twice", "en", "twin2")] * 2


@pytest.mark.parametrize(("least", "sizes"), [(3, None), (4, (7, 3, 2)), (10**6, None)])
def test_divergence(spark, monkeypatch, least, sizes):
    """Also with blocks so small that groups and vocabulary are cut into many tiles, and without any kept term."""
    if sizes:
        for name, size in zip(("CHUNK", "GROUPS", "RUN"), sizes, strict=True):
            monkeypatch.setattr(D, name, size)
    rows = spoken(least)
    docs = spark.createDataFrame([(k % 50 or None, *r, 1) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, term int")
    assert sorted(map(tuple, D.audit(docs, least=least, top=5).collect())) == plain_audit(rows, least, 5)


def test_divergence_of_nothing(spark):
    assert D.audit(spark.createDataFrame([], "doc_id long, text string, lang string, source string")).count() == 0


def test_tally_hands_on(monkeypatch):
    monkeypatch.setattr(D, "HELD", 50)
    rows = spoken(5)
    batches = [pa.RecordBatch.from_pydict({"text": [r[0] for r in part], "lang": [r[1] or "" for r in part], "source": [r[2] or "" for r in part]}) for part in (rows[:100], rows[100:])]
    got = Counter()
    for batch in D._count(iter(batches)):
        for row in batch.to_pylist():
            got[row["lang"], row["source"], row["term"]] += row["n"]
    want = Counter({(r[1] or "", r[2] or "", ""): 0 for r in rows})
    for text, lang, source in rows:
        want.update((lang or "", source or "", t) for t in plain_terms(text))
    assert dict(got) == dict(want)


def test_shares_of_huge_counts():
    r = random.Random(1)
    for _ in range(200):
        below = r.randint(10, 9 * 10**15)
        c = r.randint(0, below - 5)
        assert D.shares(np.array([c]), np.int64(below))[0] == 1 + 10**9 * (c + 5) // below


def test_share_column_is_exact(spark):
    c, n, v = 3 * 10**12 + 7, 9 * 10**14 + 1, 10**8
    assert spark.range(1).select(D.share(F.lit(c), F.lit(n), F.lit(v))).first()[0] == 1 + 10**9 * (c + 5) // (n + 5 * v)


# --- chat formatting --------------------------------------------------------------------------------------------------


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def marked_texts(seed, n):
    r = random.Random(seed)
    bits = [*C.MARKS, "\\", "\\\\", "<", "[", "/s>", "INST]", "\n", "é", "𝄞", " word ", "<\\/s>", "[\\\\INST]", "$1", "role"]
    return ["".join(r.choices(bits, k=r.randint(0, 9))) for _ in range(n)]


def test_chats_read_back(spark):
    r = random.Random(2)
    texts = marked_texts(1, 400) + [None, "", "x" * 300_000 + "</s>" * 1000]
    roles = ["user", "assistant", "system", "assistant", "to\nol</s>", None, "[INST]"]
    rows = [(k // 4 if k < 390 else None, k, r.choice(roles), t) for k, t in enumerate(texts)]
    df = spark.createDataFrame([(*x, "clash", "clash") for x in rows], "conv_id long, turn long, role string, text string, formatted string, loss string")
    got = {x["conv_id"]: x for x in C.read_back(C.format_chats(df.repartition(3))).collect()}
    by = defaultdict(list)
    for conv, _, role, text in rows:
        by[conv].append((role or "", text or ""))
    assert set(got) == set(by)
    for conv, said in by.items():
        learned = "".join(t for role, t in said if role == "assistant")
        x = got[conv]
        assert (x["n_turns"], x["turns_sha256"], x["loss_chars"], x["loss_sha256"]) == (len(said), digest("".join(f"{a}\n{b}\n" for a, b in said)), len(learned), digest(learned))


def test_spans_are_places_in_the_conversation(spark):
    rows = [(1, 0, "user", "hi <s>"), (1, 1, "assistant", "[INST] é"), (1, 2, "assistant", ""), (1, 3, "user", "x"), (1, 4, "assistant", "z")]
    x = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert x["formatted"] == "<s>[INST]user\nhi <\\s>[/INST][\\INST] é</s></s>[INST]user\nx[/INST]z</s>"
    assert [x["formatted"][s["start"] : s["start"] + s["length"]] for s in x["loss"]] == ["[\\INST] é", "", "z"]


def test_ties_nulls_and_repeats(spark):
    rows = [(None, 1, "user", "b"), (None, 1, "user", "b"), (None, 1, "assistant", "c"), (None, None, "user", "z"), (None, 1, "user", "a")]
    got = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [x["formatted"] for x in got] == ["<s>[INST]user\nz[/INST]c</s>[INST]user\na[/INST][INST]user\nb[/INST][INST]user\nb[/INST]"]
    assert C.read_back(C.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_parts(spark):
    """Typed parts become ordered placeholders with references and token counts, and read back as they were."""
    part = lambda kind, **more: {"type": kind, **more}
    turns = [
        (1, 0, "user", [part("text", text="see <|image|>"), part("text", text="s>"), part("image", ref="a.png", width=100, height=33), part("audio", ref="b.wav", seconds=2.01), part("text", text="")]),
        (1, 1, "assistant", [part("document", ref="c.pdf", pages=3), part("hologram", ref="d"), None, part("image", ref=None), part(None, text="end")]),
        (2, 0, "user", None),
        (2, 1, "assistant", []),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts array<{C.PART_TYPE}>")
    got = {x["conv_id"]: x for x in C.format_chats(df, parts="parts").collect()}
    assert got[1]["formatted"] == "<s>[INST]user\nsee <\\|image|><|text|>s><|image|><|audio|>[/INST]<|document|><|other|><|image|>end</s>"
    assert [tuple(a) for a in got[1]["attachments"]] == [
        (0, 0, 2, "image", "a.png", 7 * 3), (1, 0, 3, "audio", "b.wav", 26), (2, 1, 0, "document", "c.pdf", 3072), (3, 1, 1, "other", "d", 0), (4, 1, 2, "image", None, 1)
    ]
    assert got[1]["attachment_tokens"] == 21 + 26 + 3072 + 1 and got[2]["formatted"] == "<s>[INST]user\n[/INST]</s>"
    read = C.format_chats(df, parts="parts").select("conv_id", C.read_turns(F.col("formatted")).alias("t")).select("conv_id", F.transform("t.content", C.read_parts).alias("p"))
    back = {x["conv_id"]: [[tuple(p) for p in turn] for turn in x["p"]] for x in read.collect()}
    assert back[1] == [[("text", "see <|image|>"), ("text", "s>"), ("image", None), ("audio", None)], [("document", None), ("other", None), ("image", None), ("text", "end")]]


def plain_escape(text):
    return re.sub(r"([<\[])(\\*)(" + "|".join(re.escape(m[1:]) for m in C.MARKS) + ")", r"\1\\\2\3", text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([*C.MARKS, "\\", "<", "[", "s>", "/", "INST]", "|text|>", "a", "\n"]), max_size=12).map("".join))
def test_no_mark_is_left_in_a_text(text):
    hidden = plain_escape(text)
    assert not any(m in hidden for m in C.MARKS)


def test_escapes_like_the_plain_one(spark):
    texts = marked_texts(3, 500)
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", C.escape(F.col("t")).alias("e")).withColumn("u", C.unescape(F.col("e"))).collect()
    assert all(x["e"] == plain_escape(x["t"]) and x["u"] == x["t"] for x in got)


def test_chat_formatting_runs_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = C.read_back(C.format_chats(df))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# --- vector codes -----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds):
    """rows: (id, vector) -> sorted (id, code, error) and the digest of the codebooks."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0], r[1]))
    if not kept:
        return [], None
    w = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * w : p * w + w]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    books = [[cut(v, p) for _, v in kept[:entries]] for p in range(parts)]
    best = lambda v, p: min((far(cut(v, p), e), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        at = [[best(v, p)[1] for _, v in kept] for p in range(parts)]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [cut(v, p) for (_, v), a in zip(kept, at[p], strict=True) if a == k]
                if mine:
                    books[p][k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for i, v in kept:
        found = [best(v, p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found)))
    return sorted(out, key=str), digest(",".join(str(x) for b in books for e in b for x in e))


def vectors(seed, n, dim=16, scale=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, scale) for _ in range(dim)] for _ in range(9)]
    return [[float(np.float32(x + r.gauss(0, 0.2 * scale))) for x in r.choice(centres)] for _ in range(n)]


ODD = [None, [], [None] + [0.0] * 15, [math.nan] + [0.0] * 15, [math.inf] * 16, [-math.inf] + [0.0] * 15]


@pytest.mark.parametrize(("seed", "n", "scale"), [(1, 300, 1.0), (2, 9, 1.0), (3, 120, 1e6), (4, 60, 1e12)])
def test_vector_codes(spark, seed, n, scale):
    """Also with fewer rows than entries, and with distances that leave 53 and 63 bits."""
    rows = [(i - 20, v) for i, v in enumerate(vectors(seed, n, scale=scale))]
    rows = rows + [(None, rows[0][1]), (5, rows[1][1]), (5, rows[1][1]), (6, [0.0] * 16)] + [(-100 - k, v) for k, v in enumerate(ODD)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, code string, v string")
    coded = V.compress(df.repartition(5))
    want, book = plain_codes([r for r in rows if r[1] != []], 8, 16, 6)
    want = [(i, c, e if e < 2**63 else None) for i, c, e in want]
    assert sorted(map(tuple, coded.rows.collect()), key=str) == sorted(want, key=str) and coded.books.sha256 == book


def test_vectors_of_another_length_and_none(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert V.compress(df([])).rows.count() == 0 and V.compress(df([(1, None, 1)])).books is None
    got = V.compress(df([(0, [1.0] * 7, 1), (1, [1.0] * 8, 1), (2, [0.5] * 16, 1), (3, [2.0] * 8, None), (4, [1e300] * 8, 1)])).rows
    assert sorted(r["vec_id"] for r in got.collect()) == [1, 3]


def test_label_errors(spark):
    rows = [(1, 5), (1, 7), (None, 3), (None, 4), (2, None), (3, 2**62), (3, 2**62)]
    got = V.label_errors(spark.createDataFrame(rows, "label int, error long")).collect()
    assert sorted((str(r["label"]), r["label_error"]) for r in got if r["label_error"]) == [("1", 12), ("1", 12), ("None", 7), ("None", 7)]
    assert len(got) == len(rows)


def test_a_round_ships_only_what_moved():
    book = V.Codebooks(np.array([[[0, 0], [10, 10]]], object))
    v, before = np.array([[1, 1], [9, 9], [8, 8]]), np.array([[0], [0], [1]], np.uint8)
    after, _ = V.nearest(v, book.entries)
    V.moved(v, before, after, book)
    assert book.sums.tolist() == [[[-9, -9], [9, 9]]] and book.counts.tolist() == [[-1, 1]]
