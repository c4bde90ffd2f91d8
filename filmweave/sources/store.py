"""Tables kept in buckets by a key, and the page store built on them.

A bucketed table is written once, one file per bucket, sorted, with Bloom filters on
the key. Joins and groupings on the key then read it without a shuffle, and a
lookup by literal keys opens only those keys' buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from filmweave.operators.lookup import redirect_target
from filmweave.session import prepare
from filmweave.staging import shared_dir

#: Keys that are looked up as literals, so that other buckets stay closed; more are joined.
FEW = 1000


def save_buckets(df: DataFrame, key: str, path: str, buckets: int | None = None) -> DataFrame:
    """Write ``df`` bucketed and sorted by ``key`` under ``path`` and return the table; rows without a key go."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"filmweave_{uuid.uuid4().hex}"
    rows = df.where(F.col(key).isNotNull()).repartition(n, key).sortWithinPartitions(key)
    writer = rows.write.format("parquet").bucketBy(n, key).sortBy(key).option("path", path).option(f"parquet.bloom.filter.enabled#{key}", "true")
    writer.saveAsTable(name)
    return spark.table(name)


def open_buckets(spark: SparkSession, key: str, path: str, schema: str, buckets: int) -> DataFrame:
    """A table that an earlier session saved."""
    name = f"filmweave_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def read_keys(table: DataFrame, key: str, keys: DataFrame) -> DataFrame | None:
    """Rows of a bucketed table whose key is among ``keys`` (one column of that name): few are literals, many a join.

    None if there are no keys at all.
    """
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    few = [r[0] for r in asked.limit(FEW + 1).collect()]
    if len(few) > FEW:
        return table.join(asked, key, "left_semi")
    return table.where(F.col(key).isin(few)) if few else None


class PageStore:
    """Pages (title, text, target) by title; ``target`` is where a redirect points. Of equal titles all rows are kept."""

    def __init__(self, table: DataFrame):
        self.table = table

    @classmethod
    def write(cls, pages: DataFrame, path: str | None = None, any_case: bool = False, buckets: int | None = None) -> PageStore:
        """Keep ``pages`` (title, text), evaluated once."""
        spark = prepare(pages.sparkSession)
        target: Column = redirect_target(F.col("text"), any_case)
        place = path or f"{shared_dir(spark)}/pages/{uuid.uuid4().hex}"
        return cls(save_buckets(pages.select("title", "text", target.alias("target")), "title", place, buckets))

    def redirects(self) -> DataFrame:
        """(title, target); texts aren't read."""
        return self.table.where("target is not null").select("title", "target")

    def read(self, titles: DataFrame) -> DataFrame | None:
        """(title, text) of the pages among ``titles`` (title); None without any title."""
        found = read_keys(self.table, "title", titles)
        return None if found is None else found.select("title", "text")

    def one(self, title: str) -> DataFrame:
        """(title, text) of one page, from its bucket."""
        return self.table.where(F.col("title") == title).select("title", "text")
