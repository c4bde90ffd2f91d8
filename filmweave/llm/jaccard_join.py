"""Exact n-gram Jaccard join in a metric space, down to components.

Jaccard distance is a metric, so a pivot bounds what may lie near a document.
The join goes down in three levels, each exact (``regions`` has the theory):

1. One-shingle sets are the first pivots. Whole documents can't be: unrelated
   texts are all at distance 1, every window would hold everything. A document is
   nearer to the one-shingle sets that it contains, ties go by one global order
   (rare before frequent, then by hash), and a partner must contain one of the
   document's first ``n - ceil(0.85 n) + 1`` shingles. Regions that have one pivot
   document (the least hash among their members) become one cell. A region of more
   than ``REGION_ROWS`` members, counted exactly, whose members share hardly more
   than its shingle is divided first by size and by the second shingle: a partner's
   second shingle in common is among one more of the first ones, so members meet
   under both. Unrelated texts under one common shingle leave nothing there.
2. The cells are joined by document pivots, Voronoi cells and windows under the
   Hamming distance of parity sketches, which never exceeds the symmetric
   difference: no link is lost, and a cell gives a forest of open pairs, fewer
   than its members.
3. Documents that open pairs reach from each other are one region, every document
   in one at most. Whole sets travel to it once, and it is joined recursively and
   exactly by document pivots under the Jaccard distance itself. Its links, again
   a forest, become components.

Texts with equal sets are one class; only its smallest id takes part. Nothing is
capped or sampled; the sample of documents (one in ``SAMPLE_STEP``, more of a
small table) and the table of the commonest shingles (``KNOWN`` at most) only
decide which shingles come last in the order, and the limits of regions only which
way they are joined: cost changes, results don't. Shingles are told apart by 64-bit
hashes, in the last level by 48 bits of them: a region of that level holds at most
2 million shingles in a task, where the odds that any two collide are below 1 %.

Defined results: null, empty and blank texts have no shingles and link with
nothing; fewer words than a shingle make one shingle; rows that share an id
count as one document; a null id links with nothing (its component is the least
id of an equal text, else null); very long texts count whole; similarities of
exactly the threshold link; other columns, whatever their names, are not read;
an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents, drop_staged, stage, text_rows
from filmweave.llm.components import connected_components
from filmweave.llm.regions import Sets, Sketches, region_links
from filmweave.llm.words import shingles

#: Members of a cell and shingles of a region that one task takes; sample count of a frequent shingle.
CELL_ROWS, REGION_SHINGLES, FREQUENT = 4096, 2_000_000, 4
#: Documents of the frequency sample at least, and one in so many; frequent shingles that are known at most (16 bytes each).
SAMPLE, SAMPLE_STEP, KNOWN = 4096, 256, 1 << 20
#: Members of a region beyond which a second shingle may divide it; such regions that its members are in, on average, at most.
REGION_ROWS, FEW_REGIONS = 2048, 8


def least_overlap(n, percent: int):
    """ceil(percent / 100 * n): shingles of a set of ``n`` that a partner must share."""
    return (percent * n + 99) // 100


def frequent_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (sorted) and sample counts of the KNOWN commonest shingles that FREQUENT or more sampled documents hold.

    The sample grows with the table; the counts are made on the executors.
    """
    step = min(SAMPLE_STEP, max(1, docs.count() // SAMPLE))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty(0, np.uint64), *shingles(batch.column(0), words)]
            yield pa.RecordBatch.from_pydict({"s": np.concatenate(found).view(np.int64)})

    sample = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).select("text")
    common = text_rows(sample).mapInArrow(spread, "s long").groupBy("s").count().where(f"count >= {FREQUENT}")
    rows = common.orderBy(F.desc("count"), "s").limit(KNOWN).toArrow()
    found, counts = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy()
    order = np.argsort(found)
    return found[order], counts[order]


def describe(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Per row: doc_id, n, print (of the whole set), sketch, prefix (the shingles whose regions it visits, in order, and one more)."""
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, words))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known, counts = frequent.value
        for batch in batches:
            n, prints, sketches, prefixes = [], [], [], []
            for s in shingles(batch.column(1), words):
                first = s
                if len(known) and len(s):
                    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
                    first = s[np.argsort(np.where(known[at] == s, counts[at], 0), kind="stable")]
                n.append(len(s))
                prints.append(xxhash.xxh3_128_digest(s.tobytes()))
                sketches.append(Sketches.of(s))
                prefixes.append(first[: len(s) - least_overlap(len(s), percent) + 2 if len(s) else 0].view(np.int64))
            ends = np.cumsum([0, *map(len, prefixes)])
            prefix = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *prefixes])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(prints, pa.binary()), pa.array(sketches, pa.binary()), prefix], names=["doc_id", "n", "print", "sketch", "prefix"])

    return text_rows(docs.select("doc_id", "text")).mapInArrow(work, "doc_id long, n long, print binary, sketch binary, prefix array<long>")


def whole_sets(docs: DataFrame, ids: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, data): whole sets of the documents in ``ids`` (doc_id), shingled again from their texts."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = shingles(batch.column(1), words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array([Sets.of(s) for s in found], pa.binary())], names=["doc_id", "n", "data"])

    return text_rows(docs.select("doc_id", "text").join(ids.hint("merge"), "doc_id", "left_semi")).mapInArrow(sets, "doc_id long, n long, data binary")


def meetings(rows: DataFrame) -> DataFrame:
    """(s, cell, members) of every region (s) of ``rows`` (s, doc_id) with two members or more: its pivot document, its size."""
    mark = F.struct(F.xxhash64("doc_id").alias("h"), "doc_id")
    found = rows.groupBy("s").agg(F.min(mark).getField("doc_id").alias("cell"), F.max(mark).getField("doc_id").alias("last"), F.count("*").alias("members"))
    return found.where("cell <> last").drop("last")


def second_shingles(nodes: DataFrame, divided: DataFrame, percent: int) -> DataFrame:
    """(s, doc_id): members of the regions ``divided`` (s) by size and by each shingle after the region's own.

    If a link's first shingle in common is ``s``, its second one (above 50 percent a link of unequal sets shares two or
    more) is among one shingle more than the prefix on both sides, and after ``s`` in both.
    Sizes differ by a factor of 100 / ``percent`` at most: a document enters the class of its size and the next.
    """
    own = nodes.select("doc_id", "n", "prefix", F.posexplode("prefix").alias("at", "s")).where(F.col("at") <= _last(percent))
    after = own.join(divided, "s").select("doc_id", "s", "n", F.explode(F.slice("prefix", F.col("at") + 2, F.size("prefix"))).alias("t"))
    size = F.col("n") if percent == 100 else F.floor(F.log("n") / F.log(F.lit(100 / percent)) * (1 - 1e-9))
    return after.select(F.explode(F.array(size, size + 1)).alias("size"), "*").select(F.xxhash64("s", "t", "size").alias("s"), "doc_id")


def _last(percent: int) -> F.Column:
    """Position of the last shingle of the prefix proper."""
    return F.expr(f"n - ({percent} * n + 99) div 100")


def cells(nodes: DataFrame, percent: int) -> DataFrame:
    """(cell, doc_id), staged: documents by the pivot documents of the shingle regions that they visit, the pivot included.

    A shingle's region has the member with the least hash as its pivot; both a region's members meet in its cell, and
    a document enters a cell once, however many shingles lead there.

    Of regions beyond REGION_ROWS, those are divided by a second shingle whose members are in few such regions each:
    they share the region's shingle and hardly more. Near copies share all of theirs, and go on to document pivots.
    """
    rows = nodes.select("doc_id", F.posexplode("prefix").alias("at", "s"), "n").where(F.col("at") <= _last(percent)).select("s", "doc_id")
    shared = stage(meetings(rows), "shingle-regions")
    large = shared.where(F.col("members") > REGION_ROWS).select("s")
    if percent <= 50 or not large.limit(1).count():
        out = stage(rows.join(shared, "s").select("cell", "doc_id").distinct(), "cells")
        drop_staged(shared)
        return out
    crowded = rows.join(large, "s")
    often = crowded.groupBy("doc_id").agg(F.count("*").alias("regions"))
    divided = stage(crowded.join(often, "doc_id").groupBy("s").agg(F.avg("regions").alias("mean")).where(F.col("mean") <= FEW_REGIONS).select("s"), "divided-regions")
    met = rows.join(shared.join(divided, "s", "left_anti"), "s").select("cell", "doc_id")
    finer = second_shingles(nodes, divided, percent)
    out = stage(met.unionByName(finer.join(meetings(finer), "s").select("cell", "doc_id")).distinct(), "cells")
    for gone in (shared, divided):
        drop_staged(gone)
    return out


def join(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs`` (doc_id, text); staged."""
    docs = docs.select("doc_id", "text")
    full = stage(describe(docs, words, percent), "described")
    told = stage(full.select("doc_id", "n", "print"), "prints")
    classes = stage(told.where("n > 0 and doc_id is not null").groupBy("print").agg(F.min("doc_id").alias("rep")), "classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    nodes = stage(full.where("n > 0").join(reps, "doc_id", "left_semi").select("doc_id", "n", "sketch", "prefix"), "nodes")
    drop_staged(full)
    visited = cells(nodes, percent)
    members = stage(visited.join(nodes.select("doc_id", "n", F.col("sketch").alias("data")), "doc_id").select("cell", "doc_id", "n", "data"), "cell-members")
    for gone in (nodes, visited):
        drop_staged(gone)
    open_pairs = stage(region_links(members, Sketches, percent, CELL_ROWS, lambda: F.lit(1)), "open-pairs")
    regions = stage(connected_components(open_pairs).select(F.col("component").alias("cell"), F.col("node").alias("doc_id")), "regions")
    sets = stage(whole_sets(docs, regions.select("doc_id"), words), "sets")
    whole = stage(regions.join(sets, "doc_id").select("cell", "doc_id", "n", "data"), "region-members")
    drop_staged(sets)
    links = stage(region_links(whole, Sets, percent, REGION_SHINGLES, lambda: F.col("n")), "links")
    component = stage(connected_components(links), "components")
    by_class = classes.join(component, F.col("rep") == F.col("node"), "left").select("print", F.coalesce("component", "rep").alias("component_id"))
    return told.select("doc_id", F.col("n").alias("n_shingles"), "print").join(by_class, "print", "left").select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under 4-word shingles and a Jaccard similarity of 0.85."""
    return join(documents(spark, sf_dir))
