"""Vector codes: product quantisation in integers, by a Lloyd iteration kept up by differences.

Each vector is cut into equal parts, and each part position has a codebook of
its own. A row's last assignment is persisted beside its vector, and so is, for
every codebook entry, the running sum and count of its parts. A round is one map
over the staged rows: it assigns, compares with the assignment before, and emits
for parts that moved their components with a minus at the entry they left and a
plus at the one they joined, summed within the task. Only these sums are
shuffled; what didn't move costs nothing. The sums stay exact because all
arithmetic is in integers, so differences give just what a full recount would.

Codebooks are of fixed size (parts x entries x width), and so is what a task emits
and what the driver sees of a round. Rows and the sums are staged in the shared
folder each round, which cuts lineage; the round before is dropped.

Defined results: rows whose vector is null or holds null or non-finite components
take no part, nor do vectors whose length isn't a positive multiple of the number
of parts, is another than that of the kept row with the smallest id, or with a
component whose integer leaves 63 bits. Ids order nulls last, and equal ids by
their vectors; repeated rows count each. With fewer kept rows than entries
the codebooks have one entry per kept row. Ties go to the lower index. Squared
distances are exact at any size (beyond 53 bits in Python integers); an error that
leaves 63 bits is null. An empty table gives an empty result and no codebooks. Other
columns, whatever their names, are read only if carried.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as Y

from filmweave.llm.common import drop_staged, maybe_broadcast, stage
from filmweave.session import prepare

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components of a batch that are assigned together; bounds a worker's memory.
TOGETHER = 1 << 19

_DELTA = "part int, entry int, place int, amount decimal(38,0)"
#: Place of an entry's count among its sums.
COUNT = -1


def whole(vector: Column, scale: int = SCALE) -> Column:
    """Components as integers ``floor(scale * x)``; null unless all are finite and fit."""
    scaled = F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(F.lit(float(scale)) * x.cast("double")) < 2.0**63))
    return F.when(fine, scaled)


@dataclass
class Codebooks:
    """``entries[part, entry, place]`` as Python integers, with each entry's running ``sums`` and ``counts``."""

    entries: np.ndarray
    sums: np.ndarray = field(default=None)
    counts: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.sums is None:
            self.sums, self.counts = np.zeros(self.entries.shape, object), np.zeros(self.entries.shape[:2], object)

    def settle(self) -> Codebooks:
        """Entries at the floored mean of their parts; unused ones stay."""
        used = (self.counts > 0)[:, :, None]
        mean = self.sums // np.where(self.counts > 0, self.counts, 1)[:, :, None]
        return Codebooks(np.where(used, mean, self.entries), self.sums, self.counts)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(v: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry of every part, squared distance of every part) of vectors ``v[row, component]``."""
    parts, _, width = entries.shape
    v = v.reshape(len(v), parts, width)
    largest = max(int(np.abs(v).max(initial=0)), max(map(abs, entries.ravel().tolist()), default=0))
    kind = np.int64 if width * (2 * largest) ** 2 < 1 << 63 else object
    v, book = v.astype(kind, copy=False), entries.astype(kind)
    at, least = np.empty((len(v), parts), np.uint8), np.empty((len(v), parts), kind)
    for p in range(parts):
        far = np.zeros((len(v), len(book[p])), kind)
        for k in range(width):
            gap = v[:, p, k, None] - book[p, None, :, k]
            far += gap * gap
        at[:, p] = far.argmin(1)
        least[:, p] = far[np.arange(len(v)), at[:, p]]
    return at, least


def moved(v: np.ndarray, before: np.ndarray | None, after: np.ndarray, book: Codebooks) -> None:
    """Add to ``book``'s sums what parts took with them from ``before`` to ``after``."""
    parts, entries, width = book.entries.shape
    v = v.reshape(len(v), parts, width)
    safe = int(np.abs(v).max(initial=0)) * len(v) < 1 << 62
    for sign, at in ((-1, before), (1, after)):
        if at is None:
            continue
        changed = np.ones(after.shape, bool) if before is None else before != after
        for p in range(parts):
            rows = np.flatnonzero(changed[:, p])
            if not len(rows):
                continue
            into = np.zeros((entries, width), np.int64 if safe else object)
            np.add.at(into, at[rows, p], v[rows, p] if safe else v[rows, p].astype(object))
            book.sums[p] += sign * into.astype(object)
            book.counts[p] += sign * np.bincount(at[rows, p], minlength=entries).astype(object)


def _vectors(column: pa.ListArray | pa.ChunkedArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _assign(book: Codebooks, known: bool):
    """A round's map: rows with their new assignment, and at the end of the task the sums that moved."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, width = book.entries.shape
        delta = Codebooks(book.entries)
        schema = None
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, max(1, TOGETHER // (parts * width))):
                batch = whole_batch.slice(start, max(1, TOGETHER // (parts * width)))
                v = _vectors(batch.column("v"), parts * width)
                before = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(-1, parts) if known else None
                after, _ = nearest(v, book.entries)
                moved(v, before, after, delta)
                none = {n: pa.nulls(batch.num_rows, t) for n, t in _DELTA_TYPES}
                code = pa.array([c.tobytes() for c in after], pa.binary())
                out = pa.RecordBatch.from_pydict({"row": batch.column("row"), "v": batch.column("v"), "code": code, **none})
                schema = out.schema
                yield out
        told = [(p, e, k, int(s)) for (p, e, k), s in np.ndenumerate(delta.sums) if s] + [(p, e, COUNT, int(n)) for (p, e), n in np.ndenumerate(delta.counts) if n]
        if told:
            columns = {n: pa.array(c, t) for (n, t), c in zip(_DELTA_TYPES, zip(*told, strict=True), strict=True)}
            yield pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(len(told), f.type)) for f in schema], schema=schema)

    return work


_DELTA_TYPES = (("part", pa.int32()), ("entry", pa.int32()), ("place", pa.int32()), ("amount", pa.decimal128(38, 0)))


def _finish(entries: np.ndarray):
    """Code and error of every row under the last codebooks."""
    long = 1 << 63

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, width = entries.shape
        for whole_batch in batches:
            for start in range(0, whole_batch.num_rows, max(1, TOGETHER // (parts * width))):
                batch = whole_batch.slice(start, max(1, TOGETHER // (parts * width)))
                at, least = nearest(_vectors(batch.column("v"), parts * width), entries)
                error = [e if e < long else None for e in least.astype(object).sum(1).tolist()]
                yield pa.RecordBatch.from_pydict({"row": batch.column("row"), "code": pa.array([c.tobytes().hex() for c in at]), "error": pa.array(error, pa.int64())})

    return work


@dataclass
class Coded:
    """``rows``: (carried columns, code, error); ``books``: the final codebooks, None where no row was kept."""

    rows: DataFrame
    books: Codebooks | None


def compress(
    df: DataFrame, carry: Sequence[str] = ("vec_id",), vector: str = "embedding", order: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE
) -> Coded:
    """Codes of all rows of ``df``, two hex digits a part, with squared error and the columns to ``carry``."""
    spark = prepare(df.sparkSession)
    whole_rows = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{order}`").alias("_order"), whole(F.col(f"`{vector}`"), scale).alias("v"))
    whole_rows = whole_rows.where(f"v is not null and size(v) > 0 and size(v) % {parts} = 0")
    smallest = whole_rows.select("_order", "v").orderBy(F.isnull("_order"), "_order", "v")
    first = smallest.limit(1).collect()
    if not first:
        return Coded(whole_rows.select("row.*", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false"), None)
    length = len(first[0]["v"])
    whole_rows = whole_rows.where(F.size("v") == length)
    start = np.array([r["v"] for r in smallest.where(F.size("v") == length).limit(entries).collect()], object)
    book = Codebooks(start.reshape(len(start), parts, length // parts).swapaxes(0, 1))
    row_type = whole_rows.schema["row"].dataType.simpleString()
    staged = stage(whole_rows.select("row", "v"), "vectors")
    running = None
    for k in range(rounds):
        done = stage(staged.mapInArrow(_assign(book, k > 0), f"row {row_type}, v array<bigint>, code binary, {_DELTA}"), "assigned")
        deltas = done.where("part is not null").select("part", "entry", "place", "amount")
        summed = (deltas if running is None else running.unionByName(deltas)).groupBy("part", "entry", "place").agg(F.sum("amount").cast("decimal(38,0)").alias("amount"))
        before, running = running, stage(summed, "running-sums")
        for old in filter(None, (staged, before)):
            drop_staged(old)
        staged = done.where("part is null").select("row", "v", "code")
        book = Codebooks(book.entries)
        for r in running.collect():  # parts x entries x (width + 1) rows at most
            if r["place"] == COUNT:
                book.counts[r["part"], r["entry"]] = int(r["amount"])
            else:
                book.sums[r["part"], r["entry"], r["place"]] = int(r["amount"])
        book = book.settle()
    out = staged.select("row", "v").mapInArrow(_finish(book.entries), f"row {row_type}, code string, error bigint")
    return Coded(out.select("row.*", "code", "error"), book)


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """Add ``label_error``: the error of all rows of equal label, nulls together; null where it leaves 63 bits."""
    sums = coded.groupBy(F.col(label).alias("_label")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"))
    return coded.join(maybe_broadcast(sums), F.col(label).eqNullSafe(F.col("_label"))).withColumn("label_error", F.col("_sum").try_cast("long")).drop("_label", "_sum")


def op13_vector_codes(spark, sf_dir: str) -> DataFrame:
    coded = compress(prepare(spark).read.parquet(f"{sf_dir}/embeddings.parquet"), carry=("vec_id", "label"))
    rows = label_errors(stage(coded.rows, "codes"))
    drop_staged(coded.rows)
    return rows.select("vec_id", "code", "error", "label_error", F.lit(coded.books.sha256 if coded.books else None).cast("string").alias("codebooks_sha256"))
