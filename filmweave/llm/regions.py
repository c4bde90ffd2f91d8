"""Joining the regions of a metric space: pivots, Voronoi cells, triangle-inequality windows, recursion.

A region is a set of members of which any two may link. A link means that two
members are close, so with a metric ``d`` and a radius ``r(x)`` that no partner of
``x`` exceeds, pivots divide a region: every member lives in the cell of its
nearest pivot, and is replicated to the cell of another pivot ``p`` only where

    d(x, p) - d(x, nearest) <= 2 r(x)

because a partner ``y`` that lives with ``p`` has ``d(y, p) <= d(y, nearest of x)``.
Cells are regions again and are joined recursively, exactly:

- a region that fits one task is joined there (``join_region``): pivots divide it
  until a part is small or pivots no longer divide it; then its members are taken
  as pivots one by one, the most central first, each held only against members
  that are not yet in its component;
- a larger region is divided on the cluster, a round of pivots at a time
  (``region_links``). A cell all of whose members link to its pivot is one component
  and is done. A region that windows don't divide (all members nearly equally
  far) is dealt out in row blocks, and every two blocks meet in one task: the
  exact way for what no pivot can split.

A task's memory is bounded by the limit, and what comes out is a forest: a region
of ``m`` members gives fewer than ``m`` links, however many pairs of it are close.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import drop_staged, maybe_broadcast, stage, text_rows

#: Pivots of a round; members of a part that is small enough for pivots one by one; share of its pairs that a split must save.
PIVOTS, LEAF, WORTH = 8, 256, 0.5

ROW = "cell long, doc_id long, n long, data binary"


class Sketches:
    """Members as parity sketches: their Hamming distance never exceeds the symmetric difference of the sets.

    ``links`` is a necessary condition for a Jaccard similarity of ``percent``, never ruled out for a pair that has it.
    Distances for pivots are between the narrow sketches; a pair they leave open meets its wide ones (a bit per shingle).
    """

    BITS = 1024

    def __init__(self, n: np.ndarray, data: list[bytes], percent: int):
        self.n, self.percent, self.wide = n, percent, [np.frombuffer(x, np.uint64) for x in data]
        self.narrow = np.stack([fold_sketch(x, self.BITS) for x in self.wide])
        self.radius = (100 - percent) * n / percent
        self.order = np.argsort(-n, kind="stable")

    @classmethod
    def of(cls, s: np.ndarray) -> bytes:
        """Bit b tells whether an odd number of shingles hash to b; as many bits as shingles, rounded up, BITS at least."""
        bits = max(cls.BITS, 1 << (max(1, len(s)) - 1).bit_length())
        at = (s >> np.uint64(20) & np.uint64(bits - 1)).astype(np.int64)
        return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()

    def distance(self, i: int, to: np.ndarray) -> np.ndarray:
        return np.bitwise_count(self.narrow[to] ^ self.narrow[i]).sum(1, dtype=np.int64)

    def links(self, i: int, to: np.ndarray) -> np.ndarray:
        n, k = self.n[to], self.n[i]
        to = to[100 * np.minimum(n, k) >= self.percent * np.maximum(n, k)]
        open_ = to[(100 + self.percent) * self.distance(i, to) <= (100 - self.percent) * (self.n[to] + k)]
        if len(self.wide[i]) * 64 <= self.BITS:
            return open_
        return open_[np.fromiter(((100 + self.percent) * self._wide(i, j) <= (100 - self.percent) * int(self.n[j] + k) for j in open_.tolist()), bool, len(open_))]

    def _wide(self, i: int, j: int) -> int:
        a, b = self.wide[i], self.wide[j]
        bits = 64 * min(len(a), len(b))
        return int(np.bitwise_count(fold_sketch(a, bits) ^ fold_sketch(b, bits)).sum(dtype=np.int64))


class Sets:
    """Members as whole sets of 48-bit shingle hashes under the Jaccard distance; ``links`` is exact."""

    def __init__(self, n: np.ndarray, data: list[bytes], percent: int):
        self.n, self.percent = n, percent
        self.radius = np.full(len(n), (100 - percent) / 100 + 1e-9)
        sizes = np.array([len(x) // 6 for x in data], np.int64)
        wide = np.zeros((int(sizes.sum()), 8), np.uint8)
        wide[:, 2:] = np.frombuffer(b"".join(data), np.uint8).reshape(-1, 6)
        _, ids, held = np.unique(wide.view(np.uint64).ravel(), return_inverse=True, return_counts=True)
        # a shingle of one member is in no intersection
        shared = held[ids] > 1
        number = np.cumsum(held > 1) - 1
        owner = np.repeat(np.arange(len(n)), sizes)[shared]
        self.flat, self.mark = number[ids[shared]].astype(np.int32), np.zeros(int((held > 1).sum()) + 1, bool)
        self.ends = np.cumsum(np.bincount(owner, minlength=len(n)))
        self.starts = np.concatenate([[0], self.ends[:-1]])
        # most central first: a member that shares most of itself with many
        centre = np.bincount(owner, weights=held[ids[shared]], minlength=len(n)) / np.maximum(n, 1)
        self.order = np.argsort(-centre, kind="stable")

    @staticmethod
    def of(s: np.ndarray) -> bytes:
        return np.ascontiguousarray(s).view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()

    def shared(self, i: int, to: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of member ``i`` with others."""
        mine = self.flat[self.starts[i] : self.ends[i]]
        self.mark[mine] = True
        sizes = self.ends[to] - self.starts[to]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[to] - ends + sizes, sizes)
        hits = np.concatenate([[0], np.cumsum(self.mark[self.flat[at]])])
        self.mark[mine] = False
        return hits[ends] - hits[ends - sizes]

    def distance(self, i: int, to: np.ndarray) -> np.ndarray:
        both = self.shared(i, to)
        return 1 - both / (self.n[to] + self.n[i] - both)

    def links(self, i: int, to: np.ndarray) -> np.ndarray:
        n, k = self.n[to], self.n[i]
        to = to[100 * np.minimum(n, k) >= self.percent * np.maximum(n, k)]
        both = self.shared(i, to)
        return to[100 * both >= self.percent * (self.n[to] + k - both)]


def fold_sketch(sketch: np.ndarray, bits: int) -> np.ndarray:
    """The narrower sketch of the same set: halves combine by exclusive or."""
    while 64 * len(sketch) > bits:
        half = len(sketch) // 2
        sketch = sketch[:half] ^ sketch[half:]
    return sketch


def voronoi(d: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """``inside[x, p]``: whether member x lives in pivot p's cell or within its window, from distances ``d[x, p]``."""
    return d - d.min(1, keepdims=True) <= 2 * radius[:, None]


def join_region(space, size: int) -> list[tuple[int, int]]:
    """A forest over members 0..size-1 with the same components as all links."""
    label, forest = np.arange(size), []

    def tie(i: int, partners: np.ndarray) -> None:
        labels, first = np.unique(label[partners], return_index=True)
        other = labels != label[i]
        if other.any():
            forest.extend((i, int(j)) for j in partners[first[other]])
            label[np.isin(label, labels[other])] = label[i]

    rank = np.empty(size, np.int64)
    rank[space.order] = np.arange(size)
    open_ = [np.arange(size)]
    while open_:
        region = open_.pop()
        if (label[region] == label[region[0]]).all():
            continue
        region = region[np.argsort(rank[region])]
        if len(region) > LEAF:
            pivots = region[np.linspace(0, len(region) - 1, PIVOTS).astype(int)]
            for p in pivots:
                tie(p, space.links(p, region))
            d = np.stack([space.distance(p, region) for p in pivots], 1)
            cells = [region[inside] for inside in voronoi(d, space.radius[region]).T]
            if sum(float(len(c)) ** 2 for c in cells) <= WORTH * float(len(region)) ** 2:
                open_ += [c for c in cells if len(c) > 1]
                continue
        for k, i in enumerate(region.tolist()):
            after = region[k + 1 :]
            after = after[label[after] != label[i]]
            if not len(after):
                if (label[region] == label[i]).all():
                    break
                continue
            tie(i, space.links(i, after))
    return forest


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One batch per cell, from batches sorted by cell (their first column)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(0)[0].as_py() != cell[a]:
                yield pa.concat_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.concat_batches(held)


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    return batch.column(1).to_numpy(), batch.column(2).to_numpy(), batch.column(3).to_pylist()


def join_cells(rows: DataFrame, space: type, percent: int) -> DataFrame:
    """(a, b): forests of links of cells that each fit one task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            ids, n, data = _members(cell)
            found = np.array(join_region(space(n, data, percent), len(ids)) if len(ids) > 1 else [], np.int64).reshape(-1, 2)
            if len(found):
                yield pa.RecordBatch.from_pydict({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})

    return text_rows(rows.select("cell", "doc_id", "n", "data").repartition("cell").sortWithinPartitions("cell")).mapInArrow(work, "a long, b long")


def measure(rows: DataFrame, pivots: DataFrame, space: type, percent: int) -> DataFrame:
    """Rows with ``tied`` (pivots they link to) and ``cells`` (pivots in whose cell or window they are)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tied: list[list[int]] = [[] for _ in range(batch.num_rows)]
            cells: list[list[int]] = [[] for _ in range(batch.num_rows)]
            owner = batch.column(0).to_numpy()
            for cell in np.unique(owner).tolist():
                at = np.flatnonzero(owner == cell)
                ids, n, data = _members(batch.take(pa.array(at)))
                chosen = batch.column(4)[int(at[0])].as_py()
                pivot = [p["doc_id"] for p in chosen]
                k = len(pivot)
                with_pivots = space(np.concatenate([[p["n"] for p in chosen], n]), [p["data"] for p in chosen] + data, percent)
                to = np.arange(k, k + len(ids))
                for p in range(k):
                    for j in with_pivots.links(p, to).tolist():
                        tied[at[j - k]].append(pivot[p])
                inside = voronoi(np.stack([with_pivots.distance(p, to) for p in range(k)], 1), with_pivots.radius[k:])
                for j, p in zip(*np.nonzero(inside), strict=True):
                    cells[at[j]].append(pivot[p])
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(tied, pa.list_(pa.int64())), pa.array(cells, pa.list_(pa.int64()))], names=["cell", "doc_id", "n", "data", "tied", "cells"])

    return text_rows(rows.join(pivots, "cell")).mapInArrow(work, f"{ROW}, tied array<long>, cells array<long>")


def region_links(rows: DataFrame, space: type, percent: int, limit: int, weight: Callable[[], F.Column]) -> DataFrame:
    """(a, b): links with the same components as all links inside the regions of ``rows`` (cell, doc_id, n, data).

    A cell whose ``weight`` sums to more than ``limit`` is divided by pivots before a task takes it. ``rows`` is staged.
    """
    links, level = [], 0
    while True:
        level += 1
        large = stage(rows.groupBy("cell").agg(F.sum(weight()).alias("w")).where(F.col("w") > limit), "large-regions")
        if not large.limit(1).count():
            break
        chosen = maybe_broadcast(large)
        big = rows.join(chosen, "cell")
        draw = F.xxhash64("doc_id", F.lit(level))
        pivots = big.groupBy("cell", F.pmod(draw, F.lit(PIVOTS)).alias("k")).agg(F.min_by(F.struct("doc_id", "n", "data"), F.struct(F.xxhash64(draw), "doc_id")).alias("p"))
        pivots = stage(pivots.groupBy("cell").agg(F.collect_list("p").alias("pivots")), "pivots")  # at most PIVOTS a region
        measured = stage(measure(big.drop("w"), maybe_broadcast(pivots, 100), space, percent), "measured")
        links.append(measured.select(F.col("doc_id").alias("a"), F.explode("tied").alias("b")).where("a <> b"))
        placed = measured.select(F.col("cell").alias("parent"), "doc_id", "n", "tied", F.explode("cells").alias("pivot"))
        loose = F.sum((~F.array_contains("tied", F.col("pivot"))).cast("long"))
        cells = stage(placed.groupBy("parent", "pivot").agg(F.sum(weight()).alias("w"), loose.alias("loose")), "cells")
        whole = cells.groupBy("parent").agg(F.sum("w").alias("all"), F.max("w").alias("most"))
        split = whole.join(large.withColumnRenamed("w", "of"), F.col("parent") == F.col("cell")).where("all <= 1.5 * of and most <= 0.75 * of").select("parent")
        split = stage(split, "split-regions")
        # divided regions go on in their cells; what one pivot ties together is one component already
        go_on = cells.where("loose > 0").join(split, "parent", "left_semi").select("parent", "pivot")
        divided = (
            measured.withColumnsRenamed({"cell": "parent"})
            .withColumn("pivot", F.explode("cells"))
            .join(maybe_broadcast(go_on), ["parent", "pivot"])
            .select(F.xxhash64("parent", "pivot", F.lit(level)).alias("cell"), "doc_id", "n", "data")
        )
        # the others meet block by block, unless one pivot ties all of them
        tight = cells.groupBy("parent").agg(F.min("loose").alias("loose"), F.max("w").alias("most")).join(large.withColumnRenamed("w", "of"), F.col("parent") == F.col("cell")).where("loose = 0 and most = of").select("parent")
        stuck = stage(large.join(split, F.col("cell") == F.col("parent"), "left_anti").join(tight, F.col("cell") == F.col("parent"), "left_anti").select("cell", F.ceil(2 * F.col("w") / limit + 1).cast("long").alias("blocks")), "stuck-regions")
        home = F.pmod(F.xxhash64("doc_id", F.lit(-level)), F.col("blocks"))
        blocks = (
            measured.join(maybe_broadcast(stuck), "cell")
            .withColumn("home", home)
            .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            .select(F.xxhash64("cell", F.least("home", "other"), F.greatest("home", "other"), F.lit(-level)).alias("cell"), "doc_id", "n", "data")
        )
        links.append(join_cells(blocks, space, percent))
        small = rows.join(chosen, "cell", "left_anti").select("cell", "doc_id", "n", "data")
        before = rows
        rows = stage(small.unionByName(divided), "regions")
        drop_staged(before)
    out = join_cells(rows, space, percent)
    for more in links:
        out = out.unionByName(more)
    return out
