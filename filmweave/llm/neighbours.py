"""Approximate nearest neighbours: NN-descent builds a graph, greedy search uses it.

Start lists come from a few random sign codes: vectors sorted by code and dealt
into equal chunks get their exact neighbours within the chunk. NN-descent then
improves them in rounds of joins: around each vector its neighbours and ``K`` of
those it is a neighbour of meet (neighbours of neighbours), and each learns of
all that are nearer than its present radius and not in its list. Pairs that met
there before are left out. An edge counts as met at either end only once it took
part there; those beyond the ``K`` wait for a later round. Rounds go on until few
entries change.

A query holds a beam of the nearest found, expands its best unexpanded members
through the graph by joins, and ends when all of its beam is expanded. Distances
are Euclidean in double precision on the original vectors throughout, so scores
are exact; what is approximate is which neighbours are found.

Lists of the graph are bounded by design, the search follows all edges both
ways; every vector is indexed. Recall against brute force is measured in the tests and the README.

Defined results: null and zero vectors, vectors with null or non-finite
components or of another than the most frequent dimension, and null ids take no
part; ties go to the smaller id; of vectors that share an id the least in order
counts; other columns, whatever their names, are not read; an empty table, or one
without queries, gives an empty table; with fewer candidates all come back.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from filmweave.llm.common import drop_staged, stage, text_rows
from filmweave.session import prepare

#: Neighbours kept; sign codes; rows of a start chunk; share of changed entries that ends the descent.
K, CODES, CHUNK, SETTLED = 20, 8, 1024, 0.001
#: Beam of a query; members expanded in a round; entry points.
BEAM, EXPAND, ENTRIES = 320, 64, 64
SEED = 7

#: What an edge has yet to take part in: meetings around its start and around its end.
AHEAD, BACK = 1, 2
LISTS = "id long, ids array<long>, ds array<double>, fresh array<int>"


def _matrix(column: pa.Array, dtype: str) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, dtype).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def usable(vectors: DataFrame, id_: str = "vec_id", column: str = "embedding") -> tuple[DataFrame, str]:
    """(id, v) with v as packed little-endian components, and their numpy type; staged."""
    element = vectors.schema[column].dataType.elementType.simpleString()
    dtype = "<f4" if element == "float" else "<f8"
    clean = vectors.select(F.col(id_).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).where(
        "id is not null and x is not null and size(x) > 0 and forall(x, c -> c is not null and not isnan(c) and abs(c) < double('infinity')) and exists(x, c -> c <> 0)"
    )
    sizes = clean.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    clean = clean.where(F.size("x") == (sizes[0]["d"] if sizes else 0)).groupBy("id").agg(F.min("x").alias("x"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(dtype).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "v"])

    return stage(clean.mapInArrow(pack, "id long, v binary"), "vectors"), dtype


def _nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row indices and distances of each row's ``k`` nearest other rows."""
    sq = (x * x).sum(1)
    d = sq[:, None] + sq[None, :] - 2.0 * (x @ x.T)
    np.fill_diagonal(d, np.inf)
    k = min(k, len(x) - 1)
    at = np.argpartition(d, k - 1, axis=1)[:, :k]
    return at, np.stack([_distances(x[i], x[at[i]]) for i in range(len(x))])


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Without the cancellation of the product form, so that a pair has one distance wherever it meets."""
    return np.sqrt(((x - y) ** 2).sum(1))


def start_lists(vectors: DataFrame, dtype: str) -> DataFrame:
    """Neighbour lists from chunks of equal size along sign codes; chunks don't depend on how full a code is."""
    first = vectors.orderBy(F.xxhash64("id"), "id").limit(2000).toArrow()
    sample = _matrix(first.column("v").combine_chunks(), dtype)
    planes = np.random.default_rng(SEED).normal(size=(CODES, 14, sample.shape[1]))
    middle = np.median(np.einsum("nd,cbd->cbn", sample, planes), axis=2) if len(sample) else np.zeros((CODES, 14))
    weights = 1 << np.arange(13, -1, -1)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column(1), dtype)
            for c in range(CODES if len(x) else 0):
                bits = (x @ planes[c].T > middle[c]) @ weights
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c)), pa.array(bits), b.column(0), b.column(1)], names=["c", "code", "id", "v"])

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve(t: pa.Table) -> pa.RecordBatch:
            ids = t.column("id").to_numpy()
            at, d = _nearest(_matrix(t.column("v").combine_chunks(), dtype), K) if len(ids) > 1 else (np.empty((len(ids), 0), int), np.empty((len(ids), 0)))
            return pa.RecordBatch.from_arrays([pa.array(ids), _lists(list(ids[at]), pa.int64()), _lists(list(d), pa.float64()), _lists([np.full(len(r), AHEAD | BACK) for r in d], pa.int32())], names=["id", "ids", "ds", "fresh"])

        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= 2 * CHUNK:
                t = pa.Table.from_batches(held)
                yield solve(t.slice(0, CHUNK))
                held = t.slice(CHUNK).to_batches()
        if held and (t := pa.Table.from_batches(held)).num_rows:
            yield solve(t)

    coded = vectors.mapInArrow(code, "c long, code long, id long, v binary")
    sorted_ = coded.repartitionByRange("c", "code", "id").sortWithinPartitions("c", "code", "id")
    return sorted_.mapInArrow(near, LISTS)


def merge(lists: DataFrame, k: int = K) -> DataFrame:
    """One list per id: the ``k`` nearest of all its lists; an edge that took part in any list's meetings did. Staged."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, out = b.column(0).to_pylist(), ([], [], [])
            for r, own in enumerate(names):
                ids, ds, fresh = (np.concatenate([np.asarray(x) for x in b.column(c)[r].values.to_numpy(zero_copy_only=False)] or [np.empty(0)]) for c in (1, 2, 3))
                order = np.lexsort((fresh, ids))
                ids, ds, fresh = ids[order].astype(np.int64), ds[order], fresh[order]
                one = np.concatenate([[True], ids[1:] != ids[:-1]]) & (ids != own) if len(ids) else np.empty(0, bool)
                ids, ds, fresh = ids[one], ds[one], fresh[one]
                best = np.lexsort((ids, ds))[:k]
                for to, x in zip(out, (ids, ds, fresh), strict=True):
                    to.append(x[best])
            yield pa.RecordBatch.from_arrays([b.column(0), _lists(out[0], pa.int64()), _lists(out[1], pa.float64()), _lists(out[2], pa.int32())], names=["id", "ids", "ds", "fresh"])

    gathered = lists.groupBy("id").agg(F.collect_list("ids").alias("ids"), F.collect_list("ds").alias("ds"), F.collect_list("fresh").alias("fresh"))
    return stage(gathered.mapInArrow(work, LISTS), "graph")


def _edges(graph: DataFrame) -> DataFrame:
    return graph.select("id", F.explode(F.arrays_zip("ids", "fresh")).alias("e")).select("id", F.col("e.ids").alias("other"), F.col("e.fresh").alias("fresh"))


def _visitors(graph: DataFrame, turn: int) -> DataFrame:
    """(at, member, fresh): K of those that have ``at`` as a neighbour, first those that haven't met there; staged.

    The limit by rank runs before the shuffle too, so a vector that is near to very many sends K rows a task.
    """
    back = _edges(graph).select(F.col("other").alias("at"), F.col("id").alias("member"), (F.col("fresh").bitwiseAND(BACK) != 0).alias("fresh"))
    ranked = back.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(F.desc("fresh"), F.xxhash64("member", F.lit(turn)))))
    return stage(ranked.where(F.col("r") <= K).drop("r"), "visitors")


def descend(graph: DataFrame, vectors: DataFrame, dtype: str, turn: int) -> DataFrame:
    """A round: members that meet around a vector learn of each other."""
    known = graph.select("id", "ids", F.when(F.size("ids") >= K, F.element_at("ds", -1)).otherwise(F.lit(float("inf"))).alias("radius")).join(vectors, "id")
    visitors = _visitors(graph, turn)
    met = (
        _edges(graph)
        .select(F.col("id").alias("at"), F.col("other").alias("member"), (F.col("fresh").bitwiseAND(AHEAD) != 0).alias("fresh"))
        .unionByName(visitors)
        .groupBy("at", "member")
        .agg(F.max("fresh").alias("fresh"))
        .join(known, F.col("member") == F.col("id"))
        .groupBy("at")
        .agg(F.collect_list("member").alias("m"), F.collect_list("radius").alias("r"), F.collect_list("fresh").alias("f"), F.collect_list("v").alias("v"), F.collect_list("ids").alias("l"))
        .where("exists(f, x -> x)")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, ids, ds = [], [], []
            for r in range(b.num_rows):
                m, radius, fresh = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                x, fresh, lists = _matrix(b.column(4)[r].values, dtype), fresh.astype(bool), b.column(5)[r].values
                sq = (x * x).sum(1)
                d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2.0 * (x @ x.T), 0))
                d[~(fresh[:, None] | fresh[None, :])] = np.inf
                np.fill_diagonal(d, np.inf)
                listed, order = lists.flatten().to_numpy(zero_copy_only=False), np.argsort(m)
                place = np.minimum(np.searchsorted(m, listed, sorter=order), len(m) - 1)
                here = m[order[place]] == listed
                d[np.repeat(np.arange(len(m)), lists.value_lengths().to_numpy(zero_copy_only=False))[here], order[place[here]]] = np.inf
                i, j = np.nonzero(d < radius[:, None])
                exact = _distances(x[i], x[j])
                ok = exact < radius[i]
                i, j, exact = i[ok], j[ok], exact[ok]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                names.extend(m[i[first]])
                ids.extend(np.split(m[j], first[1:]) if len(i) else [])
                ds.extend(np.split(exact, first[1:]) if len(i) else [])
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _lists(ids, pa.int64()), _lists(ds, pa.float64()), _lists([np.full(len(x), AHEAD | BACK) for x in ids], pa.int32())], names=["id", "ids", "ds", "fresh"])

    learned = text_rows(met.select("at", "m", "r", "f", "v", "l")).mapInArrow(work, LISTS)
    seen = visitors.where("fresh").groupBy(F.col("member").alias("id")).agg(F.collect_list("at").alias("seen"))
    waits = lambda other, fresh: (fresh.bitwiseAND(BACK) != 0) & ~F.coalesce(F.array_contains("seen", other), F.lit(False))
    aged = graph.join(seen, "id", "left").select("id", "ids", "ds", F.zip_with("ids", "fresh", lambda o, f: F.when(waits(o, f), BACK).otherwise(0)).alias("fresh"))
    better = merge(aged.unionByName(learned))
    drop_staged(visitors)
    return better


def _changed(better: DataFrame, graph: DataFrame) -> float:
    """The share of entries that the graph before didn't have."""
    both = better.join(graph.select("id", F.col("ids").alias("was")), "id")
    new, all_ = both.agg(F.sum(F.size(F.array_except("ids", "was"))), F.sum(F.size("ids"))).first()
    return new / all_ if all_ else 0.0


def build_graph(vectors: DataFrame, dtype: str, rounds: int | None = None) -> DataFrame:
    """(id, ids, ds, fresh): the K nearest found of every vector, nearest first; ``rounds`` only bounds trials."""
    graph, turn, changed = merge(start_lists(vectors, dtype)), 0, 1.0
    while changed > SETTLED and turn != rounds:
        better = descend(graph, vectors, dtype, turn)
        changed = _changed(better, graph)
        drop_staged(graph)
        graph, turn = better, turn + 1
    return graph


def search(queries: DataFrame, graph: DataFrame, vectors: DataFrame, dtype: str, k: int) -> DataFrame:
    """The ``k`` nearest found for each of ``queries`` (query_id, q; members of the index start at their own node)."""
    out = _edges(graph).select(F.col("id").alias("at"), F.col("other").alias("member"))
    near = stage(out.unionByName(out.select(F.col("member").alias("at"), F.col("at").alias("member"))).distinct(), "adjacent")
    entries = vectors.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).toArrow()
    ids0, x0 = entries.column("id").to_numpy(), _matrix(entries.column("v").combine_chunks(), dtype)
    STATE = "query_id long, q binary, ids array<long>, ds array<double>, done array<boolean>"

    def state(names, q, rows) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([names, q, *(_lists(list(c), t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.float64(), pa.bool_()), strict=True))], names=["query_id", "q", "ids", "ds", "done"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for own, q in zip(b.column(0).to_pylist(), _matrix(b.column(1), dtype), strict=True):
                ids, ds = np.append(ids0[ids0 != own], own), np.append(np.sqrt(((x0[ids0 != own] - q) ** 2).sum(1)), -1.0)
                best = np.lexsort((ids, ds))
                rows.append((ids[best], ds[best], np.zeros(len(ids), bool)))
            if rows:
                yield state(b.column(0), b.column(1), rows)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_matrix(b.column(2), dtype) - _matrix(b.column(3), dtype)) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], names=["query_id", "member", "d"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in range(b.num_rows):
                ids, ds, done = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (2, 3, 4))
                done = done.astype(bool)
                done[np.flatnonzero(~done)[:EXPAND]] = True
                if b.column(5)[r].as_py() is not None:
                    more, dm = (b.column(c)[r].values.to_numpy(zero_copy_only=False) for c in (5, 6))
                    fresh = ~np.isin(more, ids)
                    ids, ds, done = np.concatenate([ids, more[fresh]]), np.concatenate([ds, dm[fresh]]), np.concatenate([done, np.zeros(fresh.sum(), bool)])
                best = np.lexsort((ids, ds))[: BEAM + 1]
                rows.append((ids[best], ds[best], done[best]))
            if rows:
                yield state(b.column(0), b.column(1), rows)

    now = stage(queries.mapInArrow(begin, STATE), "beam")
    while not now.where("exists(done, x -> not x)").isEmpty():
        todo = F.slice(F.filter(F.arrays_zip("ids", "done"), lambda e: ~e["done"]), 1, EXPAND)
        reached = (
            now.select("query_id", F.explode(todo).alias("e"))
            .join(near, F.col("e.ids") == F.col("at"))
            .select("query_id", "member")
            .distinct()
            .where("member <> query_id")
        )
        far = (
            reached.join(vectors, F.col("member") == F.col("id"))
            .join(now.select("query_id", "q"), "query_id")
            .select("query_id", "member", "v", "q")
            .mapInArrow(measure, "query_id long, member long, d double")
            .groupBy("query_id")
            .agg(F.collect_list("member").alias("more"), F.collect_list("d").alias("dm"))
        )
        after = stage(now.join(far, "query_id", "left").select("query_id", "q", "ids", "ds", "done", "more", "dm").mapInArrow(advance, STATE), "beam")
        drop_staged(now)
        now = after
    found = F.slice(F.filter(F.arrays_zip("ids", "ds"), lambda e: e["ids"] != F.col("query_id")), 1, k)
    return now.select("query_id", F.posexplode(found).alias("p", "e")).select(
        "query_id", (F.col("p") + 1).cast("int").alias("rank"), F.col("e.ids").alias("vec_id"), F.col("e.ds").alias("score")
    )


def op7_nn_descent(spark, sf_dir: str) -> DataFrame:
    """The 10 nearest found of every vector whose id is divisible by 100, among all others."""
    vectors, dtype = usable(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"))
    graph = build_graph(vectors, dtype)
    queries = vectors.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("v").alias("q"))
    return search(queries, graph, vectors, dtype, 10)
