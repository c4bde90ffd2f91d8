"""Seeds and dump pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmweave.functions.text import strip

#: Only the fields that anything reads; an empty ``<text/>`` has a struct with a null value, a missing one a null struct.
PAGE_SCHEMA = "title string, revision struct<text struct<_VALUE string>>"


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    """(seed): stripped lines that aren't blank."""
    return spark.read.text(path).select(strip("value").alias("seed")).where("seed <> ''")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(title, text, pos) of every ``page`` of a dump; an empty text element is null, a missing one is ''."""
    raw = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(path)
    missing = F.col("revision").isNull() | F.col("revision.text").isNull()
    text = F.when(missing, "").otherwise(F.col("revision.text._VALUE"))
    return raw.select("title", text.alias("text"), F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("row")).alias("pos"))


def page_index(pages: DataFrame) -> DataFrame:
    """(title, text): titles that aren't empty, the last of equal ones by ``pos``."""
    return pages.where("title <> ''").groupBy("title").agg(F.max_by("text", "pos").alias("text"))


def first_lines(spark: SparkSession, path: str, n: int = 30) -> DataFrame:
    """The first raw lines of a dump."""
    return spark.read.text(path).limit(n)


def preview(pages: DataFrame, n: int = 3, chars: int = 300) -> DataFrame:
    """A few pages with the start of their texts."""
    return pages.select("title", F.substring("text", 1, chars).alias("text")).limit(n)
