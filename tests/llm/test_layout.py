"""Resharding, mixing, token files and packing."""

import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SMALL

from filmweave.llm import mixing as M, packing as P, resharding as R, tokens as K, wavelet as W

TEXTS = [None, "", " ", "a", "the cat, the Cat.", "x\n\ny  z\t", "y " * 5000, "naïve ÉÉ ﬁ", "<|endoftext|> a", "a\0b c", "12 3.4 don't", "trail ", "\nlead", "a \n b", "the cat, the Cat."]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "s%d" % (i % 3) if i % 5 else None, 7) for i, t in enumerate(texts)], "doc_id long, text string, source string, slot int")


# -- resharding


def test_plan_moves_the_fewest_bytes():
    r = random.Random(5)
    for _ in range(30):
        old, new = r.randint(1, 4), r.randint(1, 4)
        sizes = {i: sorted(r.randint(1, 50) for _ in range(r.randint(0, 4))) for i in range(old)}
        blocks = [(i, k, 1, s) for i, ss in sizes.items() for k, s in enumerate(ss)]
        if not blocks:
            continue
        plan = R.plan_transfers(blocks, new)
        moved = sum(sum(sizes[i][: plan.leaving(i)]) for i in sizes)
        each, extra = divmod(len(blocks), new)
        best = min(
            sum(s for (i, _, _, s), j in zip(blocks, where, strict=True) if i != j)
            for where in itertools.product(range(new), repeat=len(blocks))
            if sorted(where.count(j) for j in range(new)) == [each] * (new - extra) + [each + 1] * extra
        )
        assert moved == best


def laid_out(df, shard):
    from filmweave.llm.common import fresh_path

    return R.write_shards(df, shard, fresh_path(df.sparkSession, "test-layout"))


@pytest.mark.parametrize("new", [1, 3, 7])
def test_reshard_lays_out_every_row(spark, new):
    from pyspark.sql import functions as F

    laid, plan = R.reshard(laid_out(docs(spark), F.when(F.col("doc_id") != 3, F.col("doc_id") % 4)), new)
    rows = R.slots(laid, ["size", "doc_id"]).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(len(TEXTS)))
    assert {r["doc_id"]: r["text"] for r in rows} == dict(enumerate(TEXTS))
    by = {j: sorted(r["slot"] for r in rows if r["shard"] == j) for j in range(new)}
    assert all(s == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(r["size"] == len((r["text"] or "").encode()) + 8 for r in rows)
    assert sum(r["shard"] != r["old_shard"] for r in rows) == sum(plan.leaving(i) for i in plan.rows)
    assert {r["doc_id"] for r in rows if r["old_shard"] == -1} == {3}


def test_reshard_moves_the_fewest_bytes(spark):
    """Many rows per block: the least bytes are, per overfull shard, its smallest rows; who keeps one more is the choice."""
    from pyspark.sql import functions as F

    r = random.Random(8)
    for shape in ((60, 40, 7, 13), (31, 30, 30, 30), (5, 90, 0, 1)):
        texts = [(i, "x" * r.randint(0, 300)) for i, n in enumerate(shape) for _ in range(n)]
        df = spark.createDataFrame([(k, t, i) for k, (i, t) in enumerate(texts)], "doc_id long, text string, at int").repartition(3)
        laid, plan = R.reshard(laid_out(df, F.col("at")), 4)
        moved = sum(x["size"] for x in laid.collect() if x["shard"] != x["old_shard"])
        each, extra = divmod(len(texts), 4)
        best = min(
            sum(sum(sorted(len(t) + 8 for j, t in texts if j == i)[: max(0, n - each - (i in more))]) for i, n in enumerate(shape))
            for more in itertools.combinations(range(4), extra)
        )
        assert moved == best
        # shards that nothing leaves keep their files
        files = {f.rsplit("/", 1)[1] for f in laid.where(~F.col("old_shard").isin(sorted(plan.rewritten()) or [-9])).inputFiles()}
        assert files and plan.rewritten() == {i for i, n in enumerate(shape) if plan.leaving(i)}


def test_reshard_leaves_full_shards_alone(spark):
    from pyspark.sql import functions as F

    laid, plan = R.reshard(laid_out(docs(spark, ["a"] * 12), F.col("doc_id") % 3), 3)
    assert plan.rewritten() == set() and all(r["shard"] == r["old_shard"] for r in laid.collect()) and laid.count() == 12
    assert R.reshard(laid_out(docs(spark, []), F.lit(0)), 3)[0].count() == 0


def test_reshard_tells_equal_rows_and_null_ids_apart(spark):
    from pyspark.sql import functions as F

    rows = [(None, "same", 0)] * 9 + [(1, "same", 0)] * 5 + [(2, None, 1)]
    laid, _ = R.reshard(laid_out(spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(3), F.col("size")), 3)
    got = laid.collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == sorted((a or 0, b or "") for a, b, _ in rows)
    assert [sum(r["shard"] == j for r in got) for j in range(3)] == [5, 5, 5]


def test_resharding_query(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in R.op1_resharding(spark, folder).collect()}
    want = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(want)
    assert all(got[i]["size"] == len(t) + 8 and got[i]["text_crc32"] == zlib.crc32(t) and got[i]["law"] == "rows" and got[i]["grown_shard"] is None for i, t in want.items())
    by = [sorted(r["slot"] for r in got.values() if r["shard"] == j) for j in range(24)]
    assert all(s == list(range(len(s))) for s in by) and {len(s) for s in by} <= {len(want) // 24, len(want) // 24 + 1}


# -- mixing


def test_targets():
    got = M.targets([("a", 100), ("b", 100), (None, 100), ("c", 1)])
    assert got["c"] == 3.0 and abs(sum(got.values()) - 301) < 1e-9 and abs(got["b"] / got["a"] - 2) < 1e-9 and got[None] == got["a"]
    assert M.targets([("a", 0), ("b", 10)]) == {"a": 0.0, "b": 10.0}
    assert M.targets([]) == {}


def test_mix_meets_targets(spark):
    r = random.Random(6)
    texts = ["w " * r.choice([0, 1, 5, 30, 400]) for _ in range(900)] + [None, "x"]
    df = docs(spark, texts)
    narrow = M.sized_rows(M.known_rows(df.select("doc_id", "source", "text")))
    rows = M.decide(narrow).collect()
    again = {(x["doc_id"], x["copies"]) for x in M.decide(M.sized_rows(M.known_rows(df.select("doc_id", "source", "text").repartition(7)))).collect()}
    assert {(x["doc_id"], x["copies"]) for x in rows} == again and len(rows) == len(texts)
    assert all(x["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[x["doc_id"]] or "")) and 0 <= x["copies"] <= 3 for x in rows)
    for s in {x["source"] for x in rows}:
        own = [x for x in rows if x["source"] == s]
        assert abs(sum(x["size"] * x["copies"] for x in own) - own[0]["target"]) <= 30
        assert own[0]["source_size"] == sum(x["size"] for x in own)


def test_settle_keeps_expectations():
    import pandas as pd

    rng = np.random.default_rng(1)
    total = np.zeros(6)
    for _ in range(3000):
        run = pd.DataFrame({"size": [50, 20, 20, 5, 3, 1], "p": [0.3] * 6, "whole": [0] * 6, "draw": rng.integers(0, 2**63, 6)})
        out = M.settle(run, last=False)
        assert abs((out["p"] * out["size"]).sum() - 0.3 * 99) < 1e-6 and (~out["resolved"]).sum() <= 1
        total += out["p"]
    assert np.abs(total / 3000 - 0.3).max() < 0.04


def test_pairs_against_an_independent_version():
    """Each step changes two probabilities only, keeps the words, and makes one of the two integral."""
    from fractions import Fraction

    r = random.Random(3)
    for _ in range(50):
        size = sorted((r.choice([1, 2, 7, 50, 400]) for _ in range(r.randint(1, 12))), reverse=True)
        luck = [r.random() for _ in size]
        p = [r.choice([0.25, 0.5, 0.75])] * len(size)
        exact, open_ = [Fraction(x) for x in p], []
        for j, s in enumerate(size):
            open_.append(j)
            if len(open_) < 2:
                continue
            i, j = open_
            up, down = min(size[i] * (1 - exact[i]), size[j] * exact[j]), min(size[i] * exact[i], size[j] * (1 - exact[j]))
            words = up if luck[j] < float(down / (up + down)) else -down
            exact[i] += words / size[i]
            exact[j] -= words / size[j]
            open_ = [k for k in open_ if 0 < exact[k] < 1]
            assert len(open_) < 2
        left = M.pair(size, p, luck)
        assert np.allclose(p, [float(x) for x in exact]) and ([left] if left is not None else []) == open_


def test_mix_repeats_rows(spark):
    df = docs(spark, ["a b c", "d", None, "e f"] * 4).unionByName(docs(spark, ["a b c"])).selectExpr("*", "slot as size", "slot as occ", "slot as row", "slot as doc", "map(1, slot) as m")
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    want = {}
    for x in M.decide(M.sized_rows(M.known_rows(df))).collect():
        want[x["doc_id"]] = want.get(x["doc_id"], 0) + x["copies"]
    got = {r["doc_id"]: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert got == {k: v for k, v in want.items() if v}
    assert M.mix(docs(spark, [])).count() == 0


def test_mix_takes_null_ids_for_themselves(spark):
    rows = [(None, f"w{i} x", "s") for i in range(40)] + [(7, f"v{i}", None) for i in range(40)] + [(None, "w0 x", "s")] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rows = M.decide(M.sized_rows(M.known_rows(df))).collect()
    assert len(rows) == 83 and {r["source_size"] for r in rows} == {40, 86}
    assert all(abs(sum(r["size"] * r["copies"] for r in rows if r["source"] == s) - next(r["target"] for r in rows if r["source"] == s)) <= 1 for s in ("s", None))


def test_mixing_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = M.op2_mixing(spark, folder).collect()
    texts = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]]["text"] or "")) and r["taken"] <= 3 * r["size"] and r["source"] == texts[r["doc_id"]]["source"]
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    want = M.targets(list(sizes.items()))
    assert all(r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 for r in rows)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] for s in sizes)


# -- tokens


@pytest.mark.parametrize(("name", "spaced"), [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_encoder_equals_the_library(spark, name, spaced, monkeypatch):
    texts = [t for t in TEXTS if t] + [r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(60).collect()]
    texts += ["a  b", "a \xa0b", "\x85x \x1cy", "ΑΣ Σ.", "é ", "...,. ,,", "'s 's", "a\n b", "a\n\n\nb", " ", "\n"]
    encoder = K.Encoder(K.place(name), spaced)
    want = [encoder.whole(t).tobytes() for t in texts]
    assert encoder.batch(texts) == want and encoder.batch(texts) == want
    monkeypatch.setattr(K, "CACHE_PIECES", 3)
    assert K.Encoder(K.place(name), spaced).batch(texts) == want


@pytest.mark.parametrize(("n", "top"), [(0, 1), (1, 1), (1000, 2), (4097, 50_000), (5000, 70_000), (300_000, 900)])
def test_wavelet_matrix(n, top):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, top, n)
    w = W.WaveletMatrix.from_bytes(W.WaveletMatrix.build(ids).to_bytes())
    for at in range(0, n, max(97, n // 60)):
        token = int(ids[at])
        assert w.access(at) == token and w.count(token, at // 2, at) == (ids[at // 2 : at] == token).sum()
        where = np.flatnonzero(ids == token)
        assert w.locate(token, int(np.searchsorted(where, at))) == at
    places = rng.integers(0, n, 50) if n else np.empty(0, int)
    assert (w.access_all(places) == ids[places]).all()
    assert w.count_all(1, places // 2, places).tolist() == [int((ids[p // 2 : p] == 1).sum()) for p in places]
    assert (w.decode() == ids).all()
    assert w.count(1 << 20) == 0
    with pytest.raises(IndexError):
        w.access(n)


def test_access_reads_only_what_it_needs():
    ids = np.random.default_rng(1).integers(0, 50_000, 2_000_000)
    raw, read = W.WaveletMatrix.build(ids).to_bytes(), []
    w = W.WaveletMatrix.open(lambda a, size: (read.append(size), raw[a : a + size])[1])[0]
    opened = sum(read)
    assert w.access(1_234_567) == ids[1_234_567] and sum(read) - opened <= w.bits * (W.CHUNK + 1000) and sum(read) < len(raw) / 4
    with pytest.raises(ValueError, match="not a wavelet"):
        W.WaveletMatrix.open(lambda a, size: b"x" * size)


def test_token_files(spark):
    folder = W.fresh_path(spark, "t")
    df = docs(spark).unionByName(docs(spark, ["a"])).unionByName(docs(spark, ["no id", None, "x" * 200_000, "no id"]).selectExpr("cast(null as long) as doc_id", "text", "source", "slot"))
    manifest = W.encode_files(df.select("doc_id", "text"), folder, K.place("byte_bpe_50k.json"), shard_ids=50)
    rows = sorted(map(tuple, W.read_documents(manifest, folder).collect()), key=lambda r: r[1])
    assert manifest.count() > 1 and [r[0] for r in rows] == [None] * 4 + [0, *range(len(TEXTS))]
    raw, at, everything = K.tokenizer(K.place("byte_bpe_50k.json")), 0, []
    want = {}
    for i, t in [*enumerate(TEXTS), (0, "a"), (None, "no id"), (None, None), (None, "x" * 200_000), (None, "no id")]:
        ids = [*raw.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids.count(2), 2))
        everything += ids
    for i, start, *told in rows:
        assert start == at
        want[i].remove(tuple(told))
        at += told[0]
    assert not any(want.values())
    found = {r["token"]: r for r in W.lookup(manifest, folder, [2, everything[-2], 49_999, 2]).collect()}
    assert {t: r["n"] for t, r in found.items()} == {t: everything.count(t) for t in found} and found[2]["first"] == rows[0][1] + rows[0][2] - 1
    empty = W.encode_files(docs(spark, []).select("doc_id", "text"), folder + "e", K.place("byte_bpe_50k.json"))
    assert W.read_documents(empty, folder + "e").count() == 0


def test_wavelet_query(spark):
    folder = "/root/testdata/sf0.001"
    raw, at = K.tokenizer(K.place("byte_bpe_50k.json")), 0
    got = {r["doc_id"]: r for r in W.op6_wavelet(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.array([*raw.encode(texts[i] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


# -- packing


def check_plan(histogram, capacity):
    placed, bins = P.plan_bins(histogram, capacity)
    filled = {}
    ranks = {n: [] for n in histogram}
    for n, a, b, first, each, offset in placed:
        for r in range(a, b):
            ranks[n].append(r)
            filled.setdefault(first + (r - a) // each, []).append((offset + (r - a) % each * n, n))
    assert all(sorted(v) == list(range(histogram[n])) for n, v in ranks.items())
    for items in filled.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= capacity
    assert set(filled) == set(range(bins))
    return bins


def test_plan_bins():
    r = random.Random(8)
    for _ in range(300):
        capacity = r.choice([7, 30, 100])
        histogram = {n: r.randint(1, 9) for n in r.sample(range(1, capacity + 1), r.randint(1, min(12, capacity)))}
        items = [n for n, c in histogram.items() for _ in range(c)]
        bins = check_plan(histogram, capacity)
        gaps = []  # plain best-fit decreasing, one item at a time
        for n in sorted(items, reverse=True):
            fit = [g for g in gaps if g >= n]
            if fit:
                gaps.remove(min(fit))
                gaps.append(min(fit) - n)
            else:
                gaps.append(capacity - n)
        assert -(-sum(items) // capacity) <= bins <= len(gaps) + 1
    assert P.plan_bins({}) == ([], 0)
    check_plan({683: 5, 682: 7, 1366: 4, 2048: 2, 1: 3, 1024: 5}, 2048)


def test_pack(spark):
    df = docs(spark).unionByName(docs(spark, ["a"]))
    packed = P.pack(P.pieces(df, K.place("word_bpe_49k.json"), keep_ids=True))
    rows = packed.collect()
    raw = K.tokenizer(K.place("word_bpe_49k.json"))
    want = sorted(tuple([*raw.encode(t or "", add_special_tokens=False).ids, 0]) for t in [*TEXTS, "a"])
    whole = {}
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(bytes(r["ids"])) and len(r["ids"]) == 4 * r["length"] and 1 <= r["length"] <= 2048
        whole.setdefault(r["doc_id"], []).append((r["start"], r["piece"], np.frombuffer(bytes(r["ids"]), "<u4").tolist()))
    assert len(rows) == sum(-(-len(w) // 2048) for w in want)
    long = sorted(whole[6])
    assert [p for _, p, _ in long] == list(range(len(long))) and tuple(x for _, _, ids in long for x in ids) in want
    joined = {r["sequence_id"]: bytes(r["ids"]) for r in P.sequences(packed).collect()}
    for r in rows:
        assert joined[r["sequence_id"]][4 * r["offset"] : 4 * (r["offset"] + r["length"])] == bytes(r["ids"])
    assert sum(map(len, joined.values())) == 4 * sum(map(len, want))
    assert P.pack(P.pieces(docs(spark, []), K.place("word_bpe_49k.json"))).count() == 0


def test_op8_as_registered(spark):
    """The query itself: columns, types, and on the small table every id once, in place, in about as few sequences as can be."""
    import tokenizers

    got = P.op8_packing(spark, SMALL)
    assert dict(got.dtypes) | {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"} == dict(got.dtypes)
    tokenizer = tokenizers.Tokenizer.from_file(K.place("word_bpe_49k.json"))
    want, lengths = set(), []
    for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[at : at + 2048], "<u4")
            want.add((r["doc_id"], k, at, len(part), zlib.crc32(part.tobytes())))
            lengths.append(len(part))
    rows = got.collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in held.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 2048
    assert len(held) <= -(-sum(lengths) // 2048) * 1.1
