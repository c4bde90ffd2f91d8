"""Building blocks shared by the corpus operators.

Nothing here depends on one operator: staging tables in the folder that the
cluster shares, numbering rows globally without a single-task window,
size-checked broadcasting, and one kept object per Python worker.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmweave.session import prepare
from filmweave.staging import shared_dir

#: Rows of a table that may be broadcast; beyond it a shuffle join is used.
BROADCAST_ROWS = 200_000
#: Rows in an Arrow batch that carries whole texts (bounds worker memory).
TEXT_BATCH_ROWS = 500

#: Paths staged so far, in order; ``drop_since`` deletes the latest.
_staged: list[str] = []


def fresh_path(spark: SparkSession, name: str) -> str:
    _staged.append(f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}")
    return _staged[-1]


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and a lost executor costs one task."""
    spark = prepare(df.sparkSession)
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def drop_staged(df: DataFrame) -> None:
    """Delete a staged table that no later step reads; tables outside our part of the shared folder stay."""
    plain = lambda path: path.removeprefix("file:").lstrip("/")
    ours = plain(f"{shared_dir(df.sparkSession)}/llm/")
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()[:1]}:
        if plain(path).startswith(ours):
            _delete(df.sparkSession, path)


def staged_so_far() -> int:
    return len(_staged)


def staged_since(mark: int) -> list[str]:
    """Paths staged after ``staged_so_far`` said ``mark``."""
    return _staged[mark:]


def forget(spark: SparkSession, paths: list[str], but: DataFrame) -> list[str]:
    """Delete staged tables, save those that ``but`` still reads; these are returned."""
    read = but.inputFiles()
    needed = [p for p in paths if any(p.removeprefix("file://") in f for f in read)]
    for path in paths:
        if path not in needed:
            _delete(spark, path)
            _staged.remove(path)
    return needed


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a narrow table only after counting it; larger ones keep a shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def number_rows(df: DataFrame, order: Sequence[str], name: str, column: str = "row_no") -> DataFrame:
    """Stage ``df`` sorted by ``order`` with a gapless global row number from 0.

    Range partitions are sorted on their own; one count per partition gives the
    offsets, so no task ever holds a whole group, however hot a key is.
    """
    spark = df.sparkSession
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    staged = stage(placed, name)
    part = F.shiftright("_at", 33)
    counts = staged.groupBy(part.alias("_part")).count().orderBy("_part").collect()
    starts, total = [], 0
    for row in counts:
        starts.append((row["_part"], total))
        total += row["count"]
    offsets = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_part long, _start long"))
    return (
        staged.withColumn("_part", part.cast("long"))
        .join(offsets, "_part")
        .withColumn(column, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_part", "_at", "_start")
    )


#: Bits of the hash that rows go by; a second one of 64 bits tells unequal rows of one hash apart.
ROW_BITS = 64


def known_rows(docs: DataFrame) -> DataFrame:
    """(doc, row, check): each row whole, and two independent hashes of all its columns (of those that have no hash, their
    JSON). Rows of equal contents share both; null or repeated ids don't matter.
    """
    hashed = [F.to_json(F.col(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    row = F.shiftrightunsigned(F.xxhash64(*hashed), 64 - ROW_BITS) if ROW_BITS < 64 else F.xxhash64(*hashed)
    return docs.select(F.struct("*").alias("doc"), row.alias("row"), F.xxhash64(F.lit("check"), *reversed(hashed)).alias("check"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")


def word_count(text: F.Column | str) -> F.Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0), counted inside the JVM."""
    text = F.col(text) if isinstance(text, str) else text
    spaced = F.ltrim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.length(F.regexp_replace(spaced, "[^ ]+ *", "w")).cast("long")


def text_rows(df: DataFrame) -> DataFrame:
    """Bound the rows of each Arrow batch before whole texts go to Python."""
    prepare(df.sparkSession).conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXT_BATCH_ROWS)
    return df


_kept: dict[str, object] = {}


def keep(key: str, make: Callable[[], object]) -> object:
    """One object per Python worker; workers are reused, so it outlives a task until another key is asked for."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    return _kept[key]


def in_fold(doc_id: int, folds: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % folds


def fold(column: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(folds))


def sample_labels(labels: DataFrame, label: str, folds: int, held_out: int, per_class: int) -> list[tuple[int, int]]:
    """A bounded, repeatable sample of training labels: per class the ``per_class`` smallest id hashes.

    Rows of the held-out fold never leave the table. Repeated ids count once (their largest label).
    """
    usable = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id", folds) != held_out))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("y"))
    )
    picked: list[tuple[int, int]] = []
    for y in (0, 1):
        top = usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked += [(r["doc_id"], y) for r in top.collect()]
    return sorted(picked)


def chunks(items: Sequence, size: int) -> Iterable[Sequence]:
    for i in range(0, len(items), size):
        yield items[i : i + size]
