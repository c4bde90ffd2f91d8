"""Pages as a stream: extraction is a function of the page, so a stream of dump files needs no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from filmweave.operators.infobox import page_facts
from filmweave.sources.wiki import PAGE_SCHEMA


def page_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(title, text) of every page of the XML files that arrive in ``folder``."""
    raw = spark.readStream.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(PAGE_SCHEMA).load(folder)
    return raw.select("title", F.col("revision.text._VALUE").alias("text"))


def fact_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(title, kind, infobox) as files arrive."""
    return page_facts(page_stream(spark, folder)).select("title", "kind", "infobox")
