"""Writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

STAMP = "dd-MM-yyyy_HH-mm-ss"


def stamp_name(spark: SparkSession) -> str:
    """The time now as a file name."""
    return spark.range(1).select(F.date_format(F.current_timestamp(), STAMP)).first()[0]


def _place(df: DataFrame, folder: str, name: str | None, auto: bool) -> str:
    return f"{folder}/{stamp_name(df.sparkSession) if auto or name is None else name}"


def save_text(df: DataFrame, folder: str, name: str | None = None, auto: bool = False) -> str:
    """One text column as lines; returns the folder written."""
    df.write.text(path := _place(df, folder, name, auto))
    return path


def save_json(df: DataFrame, folder: str, name: str | None = None, auto: bool = False) -> str:
    """Rows as JSON lines, not escaped to ASCII; returns the folder written."""
    df.write.json(path := _place(df, folder, name, auto))
    return path


def pretty_json(df: DataFrame) -> DataFrame:
    """(json): each row as indented JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def records(df: DataFrame) -> tuple[list[dict], list[str]]:
    """Rows as dicts and the column names, for small results."""
    return [r.asDict(recursive=True) for r in df.collect()], df.columns
