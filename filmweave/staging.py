"""Staging tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session, as in tests, gets a folder; a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: executors share no folder to stage tables in")
        base = _fallback.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="filmweave-"))
    return base.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write and reread: lineage ends here, and a lost executor costs one task."""
    path = f"{shared_dir(df.sparkSession)}/stages/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` into as many partitions as shuffles have, whatever their bytes.

    For work that is heavy for its bytes: adaptive execution would pack small rows into one task, and also those of a
    join on the keys themselves, hence the hash.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(*keys))
