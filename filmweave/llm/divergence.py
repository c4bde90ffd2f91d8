"""Source divergence audit: how far apart the sources of a language are in their words, and which words stand out.

Words are counted per (language, source) in one map over whole texts, summed by
Spark, and cut to each language's vocabulary of terms in enough documents. The
vocabulary is numbered without a gap, and each group's counts are packed into one
sparse vector per chunk of the vocabulary. Groups are numbered within their
language and dealt into blocks; a tile is a pair of blocks over a run of
successive chunks. Every packed vector is replicated to the tiles of its block,
and a tile's task goes through its chunks one by one with two small matrices,
adding to the submatrix of its pairs. Tiles of one pair of blocks are summed.

A tile reads at most ``2 x GROUPS x RUN x CHUNK`` counts whatever a source holds, so
a source with a third of all rows weighs no more than another once it is counted,
and counting is combined within tasks before rows are shuffled. The number of
pairs of sources is the output itself.

All arithmetic is exact: ``p = 1 + floor(10^9 (count + 5) / (N + 5 V))`` by long
division in 64 bits (totals up to 9 * 10^15) and decimals of 38 digits.

Defined results: null text, language and source are ''; a text without terms still
makes its group occur; very long texts count whole; null and repeated ids and
repeated rows are documents like others; ties rank by the UTF-8 bytes of the
item; a language without kept terms has pairs of value 0 and no terms; a source
alone in its language has no pairs; an empty table gives no rows. Other columns,
whatever their names, are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from filmweave.llm.common import documents, drop_staged, maybe_broadcast, number_rows, stage, text_rows
from filmweave.llm.words import in_parts

#: Documents a kept term is in at least; smoothing of its count; scale of its share; terms reported per group.
LEAST, SMOOTH, SHARE, TOP = 30, 5, 10**9, 50
#: Terms in a chunk of the vocabulary, groups in a block, successive chunks in a tile.
CHUNK, GROUPS, RUN = 1 << 11, 32, 8
#: Distinct (group, term) counts that a task holds before it hands them on.
HELD = 1 << 20

#: What a byte of a term becomes: itself, lower-cased, or a blank that divides terms.
_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
_FOLD[0x80:] = np.arange(0x80, 0x100)

_COUNTED = "lang string, source string, term string, n bigint, docs bigint"


def terms_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct terms, term of each occurrence, text of each occurrence)."""
    texts = pc.cast(pc.fill_null(texts, ""), pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    folded = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((ends - ends[0]).astype(np.int64)), pa.py_buffer(_FOLD[data]))
    split = pc.ascii_split_whitespace(folded)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(texts)), pc.list_value_length(split).to_numpy(zero_copy_only=False))
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.filter(pa.array(real)).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), owner[real]


class _Tally:
    """Counts by (group, term) of one task, handed on when they are many."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.terms: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, groups: np.ndarray, terms: pa.Array, at: np.ndarray, owner: np.ndarray) -> None:
        number = np.fromiter((self.terms.setdefault(t, len(self.terms)) for t in terms.to_pylist()), np.int64, len(terms))
        pair, n = np.unique(owner * len(terms) + at, return_counts=True)  # one per (document, term)
        key = groups[pair // len(terms)] << 40 | number[pair % len(terms)]
        self.parts.append(_combine(key, n, np.ones(len(key), np.int64)))
        self.size += len(self.parts[-1][0])
        if self.size > 2 * HELD:
            self.parts = [_combine(*map(np.concatenate, zip(*self.parts, strict=True)))]
            self.size = len(self.parts[0][0])

    def take(self) -> pa.RecordBatch:
        key, n, docs = _combine(*map(np.concatenate, zip(*self.parts, strict=True))) if self.parts else (np.empty(0, np.int64),) * 3
        names, terms = list(self.groups), pa.array(self.terms.keys(), pa.string())
        lang, source = (pa.array([g[k] for g in names], pa.string()) for k in (0, 1))
        group = pa.array(key >> 40)
        out = [lang.take(group), source.take(group), terms.take(pa.array(key & (1 << 40) - 1)), pa.array(n), pa.array(docs)]
        alone = [lang, source, pa.array([""] * len(names), pa.string()), pa.array(np.zeros(len(names), np.int64)), pa.array(np.zeros(len(names), np.int64))]
        self.__init__()
        return pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(out, alone, strict=True)], ["lang", "source", "term", "n", "docs"])


def _combine(key: np.ndarray, n: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    return (key[first], np.add.reduceat(n[order], first), np.add.reduceat(docs[order], first)) if len(key) else (key, n, docs)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tally = _Tally()
    for batch in batches:
        names = list(zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True))
        first = 0
        for texts in in_parts(batch.column("text"), 1 << 21):
            groups = np.fromiter((tally.groups.setdefault(g, len(tally.groups)) for g in names[first : first + len(texts)]), np.int64, len(texts))
            first += len(texts)
            tally.add(groups, *terms_of(texts))
            if tally.size > HELD or len(tally.terms) > HELD:
                yield tally.take()
    yield tally.take()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of all texts; the term '' stands for the group itself, which has no counts."""
    plain = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    told = text_rows(plain).mapInArrow(_count, _COUNTED)
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (count + 5) / (total + 5 terms))``, exact."""
    wide = lambda c, n: c.cast(f"decimal({n},0)")
    above, below = wide(F.lit(SHARE), 10) * wide(count + SMOOTH, 19), wide(total + SMOOTH * terms, 19)
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def shares(count: np.ndarray, below: np.ndarray) -> np.ndarray:
    """The same in 64 bits by long division, three digits at a time."""
    out, rest = np.zeros_like(count), count + SMOOTH
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // below
        rest = rest % below
    return out + 1


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(tile, chunk, side, group, below, width, places, counts) of every row."""
    for batch in batches:
        plain = [batch.column(k).to_pylist() for k in ("lang", "a", "b", "run", "chunk", "side", "g", "below", "width")]
        places, counts = batch.column("places"), batch.column("counts")
        ends, at, n = places.offsets.to_numpy(), places.values.to_numpy(), counts.values.to_numpy()
        shift = counts.offsets[0].as_py() - ends[0]
        for i, (lang, a, b, run, *rest) in enumerate(zip(*plain, strict=True)):
            yield (lang, a, b, run), *rest, at[ends[i] : ends[i + 1]], n[ends[i] + shift : ends[i + 1] + shift]


def _tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile and chunk to the pairs of each tile, summed over its chunks; two dense matrices at a time."""

    def matrix(vectors: list[tuple], side: int) -> tuple[list[int], np.ndarray]:
        mine = sorted((v for v in vectors if v[2] == side), key=lambda v: v[3])
        out = np.zeros((len(mine), vectors[0][5]), np.int64)
        for row, (*_, below, _, places, n) in zip(out, mine, strict=True):
            row[places] = n
            row[:] = shares(row, below)
        return [v[3] for v in mine], out

    for (lang, a, b, _), tile in groupby(_vectors(batches), key=lambda v: v[0]):
        total: Counter[tuple[int, int]] = Counter()
        for _, same in groupby(tile, key=lambda v: v[1]):
            vectors = list(same)
            left, x = matrix(vectors, 0)
            right, y = (left, x) if a == b else matrix(vectors, 1)
            for g, of in zip(left, x, strict=True):
                for h, far in zip(right, np.abs(y - of).sum(1).tolist(), strict=True):
                    if g < h:
                        total[g, h] += far
        if total:
            g, h = zip(*total, strict=True)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(total), pa.string()), "g": pa.array(g, pa.int64()), "h": pa.array(h, pa.int64()), "value": pa.array(total.values(), pa.int64())})


def _numbered(df: DataFrame, within: str, order: str, name: str) -> DataFrame:
    """Gapless numbers from 0 in each ``within``, by ``order``."""
    rows = stage(number_rows(df, [within, order], name, "_n"), f"{name}-numbered")
    first = rows.groupBy(within).agg(F.min("_n").alias("_first"))
    return rows.join(first, within).withColumn(name, F.col("_n") - F.col("_first")).drop("_n", "_first")


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): all other sources by divergence, and the ``top`` terms over the language's share."""
    told = stage(counts(docs), "term-counts")
    kept = told.where("term != ''").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n_lang")).where(F.col("docs") >= least)
    vocabulary = stage(_numbered(kept.drop("docs"), "lang", "term", "place"), "vocabulary")
    langs = vocabulary.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("n_lang").alias("total_lang"))
    rows = stage(told.where("term != ''").drop("docs").join(vocabulary, ["lang", "term"]), "kept-counts")
    totals = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = told.where("term = ''").select("lang", "source").join(langs, "lang", "left").join(totals, ["lang", "source"], "left").na.fill(0, ["terms", "total", "total_lang"])
    groups = stage(_numbered(groups, "lang", "source", "g"), "groups")
    drop_staged(told)

    p, q = share(F.col("n"), F.col("total"), F.col("terms")), share(F.col("n_lang"), F.col("total_lang"), F.col("terms"))
    above = rows.join(maybe_broadcast(groups.drop("g")), ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    found = stage(_pairs(rows, groups), "divergences")
    named = found.join(groups.select("lang", "g", F.col("source").alias("left")), ["lang", "g"]).join(groups.select("lang", F.col("g").alias("h"), F.col("source").alias("right")), ["lang", "h"])
    both = named.select("lang", "value", F.explode(F.array(F.struct(F.col("left").alias("source"), F.col("right").alias("item")), F.struct(F.col("right").alias("source"), F.col("left").alias("item")))).alias("of"))
    pairs = both.select("lang", "of.source", "of.item", "value").withColumn("rank", F.row_number().over(ranked)).withColumn("part", F.lit("pair"))
    columns = ("lang", "source", "part", "item", "value", "rank")
    return pairs.select(*columns).unionByName(terms.select(*columns))


def _pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, g, h, value) of every two groups of a language, ``g < h``."""
    whole = lambda c, n: F.floor(c / n).cast("long")
    groups = groups.withColumn("block", whole(F.col("g"), GROUPS))
    blocks = groups.groupBy("lang").agg((F.max("block") + 1).alias("blocks"))
    sparse = rows.join(maybe_broadcast(groups.select("lang", "source", "g")), ["lang", "source"])
    at = F.struct((F.col("place") % CHUNK).cast("int").alias("place"), "n")
    packed = sparse.groupBy("lang", "g", whole(F.col("place"), CHUNK).alias("chunk")).agg(F.collect_list(at).alias("ats"))  # at most CHUNK
    # every group has a vector in every chunk, if an empty one: unseen terms have their share too
    last = F.greatest(F.lit(0).cast("long"), whole(F.col("terms") - 1, CHUNK))
    every = groups.join(blocks, "lang").select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("chunk"))
    vectors = every.join(packed, ["lang", "g", "chunk"], "left").select(
        "lang", "g", "chunk", "block",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"),
        whole(F.col("chunk"), RUN).alias("run"),
        (F.col("total") + SMOOTH * F.col("terms")).alias("below"),
        F.least(F.lit(CHUNK).cast("long"), F.col("terms") - F.col("chunk") * CHUNK).alias("width"),
        F.coalesce("ats.place", F.array().cast("array<int>")).alias("places"),
        F.coalesce("ats.n", F.array().cast("array<bigint>")).alias("counts"),
    )
    dealt = vectors.select(F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"), (F.col("other") < F.col("block")).cast("int").alias("side"), "*")
    tiles = dealt.drop("block", "other").repartition("lang", "a", "b", "run").sortWithinPartitions("lang", "a", "b", "run", "chunk", "side", "g")
    told = text_rows(tiles).mapInArrow(_tile, "lang string, g bigint, h bigint, value bigint")
    return told.groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def op11_divergence(spark, sf_dir: str) -> DataFrame:
    return audit(documents(spark, sf_dir))
