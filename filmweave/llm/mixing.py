"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies, target over
source size. Its whole part is taken at once; the fractional parts are rounded
dependently: two documents meet, probability mass (weighted by their words, so
the source's total stays put) moves from one to the other, up or down with the
odds that keep both expectations, until one of them is 0 or 1; the other meets
the next. Each block of a source goes from its largest document to its smallest
and leaves at most one fractional; these residuals combine in a reduction tree
of bounded fan-in, level by level. At the root one document of a source may be
left: it is rounded to the nearer side, and what that adds or takes away is made
up by turning smaller documents of the same run, the largest that fit first.
Reruns agree: blocks and draws depend on the rows' contents alone.

A row is known by two hashes of its contents, so null or repeated ids are spread like
any others, and only rows that are equal throughout are told apart by number.

Defined results: null or blank texts have size 0 and are rounded to the nearer
side without moving words; a null source is a source of its own, last in order; a
source without words has target 0 and takes nothing; rows of equal contents and
rows of one id are taken each for itself; ties in size go by the draw; very long
texts count whole; extra columns are carried along; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from filmweave.llm.common import documents, known_rows, maybe_broadcast, stage, word_count

#: Documents that a block of the first level holds on average, and blocks that meet at the next.
BLOCK_ROWS, FAN_IN = 2048, 64
#: Copies of a document at most.
MOST = 3
#: Decides the draws; another value gives another mix of the same expectation.
SEED = 20_261

SCHEMA = "doc_id long, source string, row long, check long, occ long, size long, source_size long, target double, whole int, p double, blocks long, block long, draw long, resolved boolean, copies int"


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = (1, 2, 3), most: int = MOST) -> dict[str | None, float]:
    """Target words by source: shares by weight (sources in code-point order, null last, weights repeating), at most
    ``most`` times a source's size; what exceeds that is shared again by weight until no target does."""
    ordered = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: float(weights[k % len(weights)]) for k, (s, _) in enumerate(ordered)}
    cap = {s: float(most * n) for s, n in ordered}
    open_, left, found = dict(weight), float(sum(n for _, n in ordered)), {}
    while open_:
        total = sum(open_.values())
        over = [s for s, w in open_.items() if left * w / total > cap[s]]
        if not over:
            return found | {s: left * w / total for s, w in open_.items()}
        for s in over:
            found[s] = cap[s]
            del open_[s]
        left = sum(n for _, n in ordered) - sum(found.values())
    return found


def pair(size: list[float], p: list[float], luck: list[float]) -> int | None:
    """Round ``p`` in place, in the order given, by single pairs; the one that stays fractional, if any."""
    left = None
    for j in range(len(p)):
        if not 0 < p[j] < 1:
            continue
        if left is None:
            left = j
            continue
        i = left
        # words that may move to i, and from i, until one of the two is integral
        rise, fall = min(size[i] * (1 - p[i]), size[j] * p[j]), min(size[i] * p[i], size[j] * (1 - p[j]))
        moved = rise if luck[j] * (rise + fall) < fall else -fall
        p[i], p[j] = p[i] + moved / size[i], p[j] - moved / size[j]
        for k in (i, j):
            p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
        left = i if 0 < p[i] < 1 else j if 0 < p[j] < 1 else None
    return left


def settle(run: pd.DataFrame, last: bool) -> pd.DataFrame:
    """Round one run of fractional rows, largest first; the ``last`` run of a source leaves none fractional."""
    size, p = run["size"].astype(float).tolist(), run["p"].astype(float).tolist()
    left = pair(size, p, ((run["draw"].to_numpy("int64") & 0xFFFFFFFF) / 2.0**32).tolist())
    if last and left is not None:
        to = float(p[left] >= 0.5)
        missing, p[left] = size[left] * (p[left] - to), to
        for k in range(len(p)):
            if k != left and 0 < size[k] <= abs(missing) and p[k] == float(missing < 0):
                p[k], missing = 1 - p[k], missing + (size[k] if missing < 0 else -size[k])
    done = np.array(p)
    return run.assign(p=done, resolved=(done == 0) | (done == 1), copies=run["whole"].to_numpy("int64") + (done == 1))


def pivotal(batches: Iterator[pd.DataFrame], last: bool) -> Iterator[pd.DataFrame]:
    """Settle the runs of equal (source, block); one row of each may stay fractional, none if ``last``."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        run = (~(batch["source"].eq(batch["source"].shift()) | (batch["source"].isna() & batch["source"].shift().isna())) | batch["block"].ne(batch["block"].shift())).cumsum()
        rest = batch[run == run.iloc[-1]] if len(batch) else None
        for _, rows in batch[run != run.iloc[-1]].groupby(run, sort=False):
            yield settle(rows, last)
    if rest is not None and len(rest):
        yield settle(rest, last)


def decide(sized: DataFrame) -> DataFrame:
    """Copies of each row of (doc_id, source, row, check, occ, size): adds source_size, target, copies."""
    spark = sized.sparkSession
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    want = targets([(r["source"], r["source_size"]) for r in per_source])
    rows = [(r["source"], r["source_size"], want[r["source"]], -(-r["n"] // BLOCK_ROWS)) for r in per_source]
    of = spark.createDataFrame(rows, "src string, source_size long, target double, blocks long")
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    draw = F.xxhash64("row", "check", "occ", F.lit(SEED))
    level = (
        sized.join(maybe_broadcast(of), F.col("source").eqNullSafe(F.col("src")))
        .drop("src")
        .withColumn("x", F.when(F.abs(expected - F.round(expected)) < 1e-9, F.round(expected)).otherwise(expected))
        .withColumn("whole", F.floor("x").cast("int"))
        .withColumn("p", F.col("x") - F.col("whole"))
        .withColumn("block", F.pmod(F.xxhash64("row", "check", "occ", F.lit(SEED + 1)), F.col("blocks")))
        .withColumns({"draw": draw, "resolved": (F.col("p") == 0) | (F.col("size") == 0), "copies": F.col("whole") + ((F.col("size") == 0) & (F.col("p") >= 0.5)).cast("int")})
        .select([c.split()[0] for c in SCHEMA.split(", ")])
    )
    done = [level.where("resolved")]
    open_, most = level.where("not resolved"), max([1, *(r[3] for r in rows)])
    names = level.columns
    k = 0
    while True:
        last = most == 1
        run = (
            open_.repartition("source", "block")
            .sortWithinPartitions("source", "block", F.desc("size"), "draw", "row", "check", "occ")
            .mapInPandas(lambda batches, last=last: pivotal(batches, last), SCHEMA)
        )
        run = stage(run, f"mix-{k}")
        done.append(run.where("resolved"))
        if last:
            break
        k, most = k + 1, -(-most // FAN_IN)
        open_ = run.where("not resolved").withColumns({"block": F.floor(F.col("block") / FAN_IN).cast("long"), "draw": F.xxhash64("draw", F.lit(k))})
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    assert out.columns == names
    return out.select("doc_id", "source", "row", "check", "occ", "size", "source_size", "target", "copies")


def sized_rows(known: DataFrame) -> DataFrame:
    """(doc_id, source, row, check, size, occ) of known rows; ``occ`` numbers rows of equal contents. Staged, without texts."""
    narrow = stage(known.select("doc.doc_id", "doc.source", "row", "check", word_count("doc.text").alias("size")), "mix-sizes")
    return narrow.withColumn("occ", F.row_number().over(Window.partitionBy("row", "check", "doc_id", "source", "size").orderBy("row")).cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix takes them: each row as often as it is taken, dropped ones gone; same columns.

    Texts meet the decisions in one join by both hashes of the row, 128 bits. Rows of equal contents are one row there,
    taken as often as all of them together.
    """
    known = known_rows(docs)
    taken = decide(sized_rows(known)).groupBy("row", "check").agg(F.sum("copies").cast("int").alias("copies"), F.count("*").alias("same"))
    taken = stage(taken.where("copies > 0"), "mix-taken")
    mixed = known.join(taken.hint("merge"), ["row", "check"])  # it grows with the documents: one plan at every size
    if taken.where("same > 1").limit(1).count():
        mixed = mixed.where("same = 1").unionByName(mixed.where("same > 1").dropDuplicates(["row", "check"]))
    return mixed.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of all documents, weights 1, 2, 3 repeating over the sources."""
    known = known_rows(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return decide(sized_rows(known)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "source")
