"""Minimum-cost-flow resharding.

The old layout is a folder of shards, each with files of its own. Rows of an old
shard leave in order of size (then id, file and place in the file), so what moves
is always the cheapest part. A shard that holds more rows than its new capacity
has only two ways to be cut, one row apart, for capacities differ by one at most;
the ranks between these cuts are the blocks of a flow network (old block -> new
shard) in which staying is free and moving costs a block's bytes. The network has
three block nodes per old shard, whatever the number of rows, and its optimum is
the exact least number of bytes.

Ranks come from a distributed sort of narrow rows (no texts). The plan goes back to
the texts as one range of sort keys per transfer, so files are rewritten by a map:
no text is shuffled. Only shards that rows leave are rewritten; a shard that only
receives keeps its files and gains some; all others stay as they are.

Defined results: a null text counts 0 bytes plus the fixed 8; rows with a null key
form an old shard of their own (-1) that every row leaves; null and repeated ids and
repeated rows are separate rows, ties go by file and place; very long texts are rows
like others; an empty table gives an empty layout; columns of the input whose names
clash with the added ones (``old_shard``, ``shard``, ``size``) are replaced.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from filmweave.llm.common import documents, fresh_path, number_rows, stage

#: Bytes that a row costs besides its text.
ROW_BYTES = 8


class FlowNetwork:
    """Successive shortest paths with potentials; costs are non-negative."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[float] = []

    def edge(self, a: int, b: int, room: int, cost: float) -> int:
        self.out[a].append(len(self.to))
        self.to += [b, a]
        self.out[b].append(len(self.to) - 1)
        self.room += [room, 0]
        self.cost += [cost, -cost]
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> int:
        potential, sent = [0.0] * len(self.out), 0
        while True:
            far = [float("inf")] * len(self.out)
            by: list[int] = [-1] * len(self.out)
            far[source], heap = 0.0, [(0.0, source)]
            while heap:
                d, a = heapq.heappop(heap)
                if d > far[a] + 1e-12:
                    continue
                for e in self.out[a]:
                    b = self.to[e]
                    reduced = d + max(0.0, self.cost[e] + potential[a] - potential[b])
                    if self.room[e] > 0 and reduced < far[b] - 1e-9:
                        far[b], by[b] = reduced, e
                        heapq.heappush(heap, (reduced, b))
            if by[sink] < 0:
                return sent
            potential = [p + min(f, far[sink]) for p, f in zip(potential, far, strict=True)]
            path, node = [], sink
            while node != source:
                path.append(by[node])
                node = self.to[by[node] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            sent += push


@dataclass
class Plan:
    """Rows that stay and move: ``moves[i]`` lists (new shard, rows) in the order in which ranks leave shard i."""

    rows: dict[int, int]
    moves: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    new_shards: int = 0

    def leaving(self, i: int) -> int:
        return sum(n for _, n in self.moves.get(i, []))

    def intervals(self) -> list[tuple[int, int, int, int, int]]:
        """(old shard, first rank, end rank, new shard, slot of the first)."""
        found, filled = [], {j: 0 for j in range(self.new_shards)}
        for i, n in sorted(self.rows.items()):
            if n > (gone := self.leaving(i)):
                found.append((i, gone, n, i, 0))
                filled[i] = n - gone
        for i in sorted(self.rows):
            at = 0
            for j, n in self.moves.get(i, []):
                found.append((i, at, at + n, j, filled[j]))
                filled[j] += n
                at += n
        return found

    def rewritten(self) -> set[int]:
        """Old shards that rows leave: only their files are written anew."""
        return {i for i, to in self.moves.items() if to}


def plan_transfers(blocks: list[tuple[int, int, int, int]], new_shards: int) -> Plan:
    """Transfers of fewest bytes. ``blocks``: (old shard, block number by size, rows, bytes), cut as by ``cuts``.

    Capacities are equal row counts, at most one apart; which shards take the extra row is part of the optimum.
    """
    rows: dict[int, int] = {}
    for i, _, n, _ in blocks:
        rows[i] = rows.get(i, 0) + n
    total = sum(rows.values())
    each, extra = divmod(total, new_shards)
    source, sink, hub, spare = 0, 1, 2, 3
    first_new = 4
    first_block = first_new + new_shards
    net = FlowNetwork(first_block + len(blocks))
    for j in range(new_shards):
        net.edge(first_new + j, sink, each, 0.0)
        net.edge(first_new + j, spare, 1, 0.0)
    net.edge(spare, sink, extra, 0.0)
    received = [net.edge(hub, first_new + j, total, 0.0) for j in range(new_shards)]
    left: dict[int, list[int]] = {}
    for k, (i, _, n, size) in enumerate(sorted(blocks)):
        node = first_block + k
        net.edge(source, node, n, 0.0)
        if 0 <= i < new_shards:
            net.edge(node, first_new + i, n, 0.0)
        left.setdefault(i, []).append(net.edge(node, hub, n, size / n))
    net.solve(source, sink)
    sent = {i: sum(net.room[e ^ 1] for e in es) for i, es in left.items()}
    taken = [net.room[e ^ 1] for e in received]
    plan = Plan(rows, {}, new_shards)
    # what leaves through the hub meets what arrives; a shard never sends to itself in an optimum
    wanted = [[j, n] for j, n in enumerate(taken) if n]
    for i in sorted(sent):
        need, moves = sent[i], []
        while need:
            j, n = wanted[0]
            moved = min(n, need)
            moves.append((j, moved))
            need -= moved
            wanted[0][1] -= moved
            if not wanted[0][1]:
                wanted.pop(0)
        if moves:
            plan.moves[i] = moves
    return plan


def cuts(n: int, each: int) -> list[int]:
    """Ranks at which a shard of ``n`` rows may be cut: all before one of them leave."""
    return [x for x in (n - each - 1, n - each) if 0 < x < n]


#: What rows of an old shard are sorted by; file and place make it unique.
KEY = ["size", "_id", "_file", "_place"]


def write_shards(docs: DataFrame, shard: F.Column, folder: str) -> DataFrame:
    """Write ``docs`` as a layout, one directory of files per shard, by a map; the layout read back."""
    own = [F.col(f"`{c}`") for c in docs.columns if c not in ("old_shard", "shard", "size")]
    laid = docs.select(*own, F.coalesce(shard.cast("int"), F.lit(-1)).alias("old_shard"))
    laid.write.option("compression", "zstd").partitionBy("old_shard").parquet(folder)
    return docs.sparkSession.read.schema(laid.schema).parquet(folder)


def _keyed(laid: DataFrame, text: str) -> DataFrame:
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")
    return laid.withColumns({"size": size, "_id": F.coalesce("doc_id", F.lit(-(2**63))), "_file": F.col("_metadata.file_name"), "_place": F.col("_metadata.row_index")})


def reshard(laid: DataFrame, new_shards: int, text: str = "text") -> tuple[DataFrame, Plan]:
    """From a layout (``write_shards``) to ``new_shards`` shards of equal row counts: the new layout's rows and the plan.

    The rows have the layout's columns, ``size``, ``old_shard`` and ``shard``, read from the files that the new layout
    consists of: rewritten ones, and untouched ones of the old folder.
    """
    spark = laid.sparkSession
    keyed = _keyed(laid, text)
    ranked = number_rows(keyed.select("old_shard", *KEY), ["old_shard", *KEY], "old-ranks", "_row")
    counts = {r["old_shard"]: r["n"] for r in ranked.groupBy("old_shard").agg(F.count("*").alias("n")).collect()}
    start, at = {}, 0
    for i in sorted(counts):
        start[i], at = at, at + counts[i]
    each = at // new_shards
    bounds = [(i, start[i], [start[i] + c for c in (cuts(counts[i], each) if 0 <= i < new_shards else [])]) for i in sorted(counts)]
    shards = F.broadcast(spark.createDataFrame(bounds or [(0, 0, [])], "old_shard int, _first long, _cuts array<long>"))
    ranked = ranked.join(shards, "old_shard")
    block = F.size(F.filter("_cuts", lambda c: c <= F.col("_row")))
    blocks = ranked.groupBy("old_shard", block.alias("block")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()
    plan = plan_transfers([(r["old_shard"], r["block"], r["n"], r["bytes"]) for r in blocks], new_shards)
    gone = sorted(plan.rewritten())
    columns = [c for c in laid.columns if c != "old_shard"] + ["size", "old_shard", "shard"]
    stay = keyed.where(~F.col("old_shard").isin(gone) if gone else F.lit(True)).withColumn("shard", F.col("old_shard")).select(columns)
    if not gone:
        return stay, plan
    # one range of sort keys per transfer: from the key at its first rank to that of the next
    steps = [(i, start[i] + a, j) for i, a, _, j, _ in plan.intervals() if i in gone]
    at_rank = F.broadcast(spark.createDataFrame(steps, "old_shard int, _row long, shard int"))
    keys = ranked.join(at_rank, ["old_shard", "_row"]).select("old_shard", "_row", "shard", *KEY).orderBy("old_shard", "_row").collect()
    ranges = [(r["old_shard"], r["shard"], tuple(r[k] for k in KEY), tuple(after[k] for k in KEY) if after and after["old_shard"] == r["old_shard"] else None) for r, after in zip(keys, [*keys[1:], None], strict=True)]
    key = "struct<size: long, _id: long, _file: string, _place: long>"
    lookup = F.broadcast(spark.createDataFrame(ranges, f"old_shard int, shard int, _from {key}, _to {key}"))
    mine = F.struct(*KEY)
    placed = keyed.where(F.col("old_shard").isin(gone)).join(lookup, "old_shard").where((mine >= F.col("_from")) & (F.col("_to").isNull() | (mine < F.col("_to"))))
    moved = placed.select(columns)
    path = fresh_path(spark, "new-layout")
    moved.write.option("compression", "zstd").partitionBy("shard").parquet(path)
    return spark.read.schema(moved.schema).parquet(path).select(columns).unionByName(stay), plan


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """Narrow ``rows`` with ``slot``: gapless numbers from 0 in each ``shard``, by ``order``."""
    numbered = number_rows(rows, ["shard", *order], "shard-slots", "_row")
    first = numbered.groupBy("shard").agg(F.min("_row").alias("_first"))
    return numbered.join(F.broadcast(first), "shard").withColumn("slot", F.col("_row") - F.col("_first")).drop("_row", "_first")


def op1_resharding(spark, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 23 under the law ``rows``, resharded from 20 shards by source checksum."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    old = write_shards(docs, F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(20)), fresh_path(spark, "old-layout"))
    laid, _ = reshard(old, 24)
    digest = stage(laid.select("doc_id", "size", F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"), "shard", "old_shard"), "layout-digest")
    return slots(digest, ["size", "doc_id", "text_crc32"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard"
    )
