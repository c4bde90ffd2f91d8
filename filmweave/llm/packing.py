"""Best-fit packing by large-item matching.

Documents become token ids with an end id; longer ones are cut into full pieces
and a rest. Packing works on the histogram of lengths: at most ``capacity``
numbers, whatever the corpus holds. Items above a third of the capacity fit at
most twice into a bin; the largest is matched with the largest that still fits
beside it, over and over. Smaller items then go, largest first, into the
smallest gap that holds them; new bins open only when no gap does. The plan
lists which ranks of each length go into which bins, and pieces find their place
by their rank within their length, from a distributed sort.

Defined results: a null or empty text is a piece of the end id alone; repeated
rows are packed each; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents, number_rows, stage, text_rows
from filmweave.llm.tokens import encoder, place, together

CAPACITY = 2048
END_ID = 0

Placement = tuple[int, int, int, int, int, int]  # length, first rank, end rank, first bin, items of this length per bin, offset


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Placement], int]:
    """Placements for ``histogram`` (length -> items) and the number of bins."""
    used = {n: 0 for n in histogram}
    left = {n: c for n, c in histogram.items() if c > 0}
    placed: list[Placement] = []
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by gap: (first bin, bins)
    bins = 0

    def put(length: int, first: int, count: int, each: int, offset: int) -> None:
        take = min(count * each, histogram[length] - used[length])
        placed.append((length, used[length], used[length] + take, first, each, offset))
        used[length] += take

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for k, n in enumerate(large):
        while left.get(n):
            # the largest partner that fits; itself counts when at least two are left
            mate = next((m for m in large[k:] if left.get(m, 0) >= 1 + (m == n) and n + m <= capacity), None)
            pairs = left[n] if mate is None else left[n] // 2 if mate == n else min(left[n], left[mate])
            put(n, bins, pairs, 1, 0)
            left[n] -= pairs
            if mate is not None:
                put(mate, bins, pairs, 1, n)
                left[mate] -= pairs
            gaps[capacity - n - (mate or 0)].append((bins, pairs))
            bins += pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        for gap in range(n, capacity + 1):
            while todo and gaps[gap]:
                first, count = gaps[gap].pop()
                each = gap // n
                full = min(count, todo // each)
                if full:
                    put(n, first, full, each, capacity - gap)
                    gaps[gap - each * n].append((first, full))
                    todo -= full * each
                if full < count and 0 < todo < each:
                    put(n, first + full, 1, todo, capacity - gap)
                    gaps[gap - todo * n].append((first + full, 1))
                    todo, full = 0, full + 1
                if full < count:
                    gaps[gap].append((first + full, count - full))
                    if not todo:
                        break
            if not todo:
                break
        if todo:
            each = capacity // n
            full, rest = divmod(todo, each)
            if full:
                put(n, bins, full, each, 0)
                gaps[capacity - each * n].append((bins, full))
                bins += full
            if rest:
                put(n, bins, 1, rest, 0)
                gaps[capacity - rest * n].append((bins, 1))
                bins += 1
    return placed, bins


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, spaced: bool = False, keep_ids: bool = False) -> DataFrame:
    """One row per piece of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32, and ``ids`` if asked for."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, step = encoder(tokenizer_path, spaced), np.uint32(end_id).tobytes(), 4 * capacity
        for batch in together(batches, 1):
            rows: list[tuple] = []
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                raw = encoded + end
                for p in range(0, len(raw), step):
                    part = raw[p : p + step]
                    rows.append((doc_id, p // step, p // 4, len(part) // 4, zlib.crc32(part), part))
            ids, number, start, length, crc, raws = zip(*rows, strict=True) if rows else [()] * 6
            columns = [pa.array(ids, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(raws, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return text_rows(docs.select("doc_id", "text")).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add (or replace) ``sequence_id`` and ``offset`` of rows with ``length`` from 1 to ``capacity``."""
    cut = cut.drop("sequence_id", "offset", "_row")
    columns = cut.columns
    keys = ["length", *(c for c in ("doc_id", "piece") if c in columns)]
    numbered = number_rows(stage(cut, "cut"), keys, "pieces", "_row")
    histogram = {r["length"]: r["n"] for r in numbered.groupBy("length").agg(F.count("*").alias("n")).collect()}
    placed, _ = plan_bins(histogram, capacity)
    first, at = {}, 0
    for n in sorted(histogram):
        first[n], at = at, at + histogram[n]
    # placements tile the ranks of each length, so their starts in row order find every row's own
    placed = sorted((first[n] + a, first[n] + b, bin_, each, offset, n) for n, a, b, bin_, each, offset in placed)
    table = [np.array(column, dtype=np.int64) for column in zip(*placed, strict=True)] if placed else []

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(batch.num_columns - 1).to_numpy()
            k = np.searchsorted(table[0], row, side="right") - 1
            nth = row - table[0][k]
            sequence, offset = table[2][k] + nth // table[3][k], table[4][k] + nth % table[3][k] * table[5][k]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*columns, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema)
    return numbered.select(*columns, "_row").mapInArrow(locate, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """Token sequences of ``packed`` rows with ``ids``: sequence_id, ids (pieces joined by offset). A sequence holds ``capacity`` ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.expr("aggregate(parts, x'', (a, p) -> a || p.ids)").alias("ids"))


def op8_packing(spark, sf_dir: str) -> DataFrame:
    """All documents' pieces in sequences of at most 2048 tokens."""
    return pack(pieces(documents(spark, sf_dir), place("word_bpe_49k.json")))
