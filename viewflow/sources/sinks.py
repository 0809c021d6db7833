"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def store_rows(df: DataFrame, path: str, compression: str = "zstd") -> DataFrame:
    """Write a relation as Parquet and return it as read from there."""
    df.write.mode("overwrite").option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def formatted(df: DataFrame, by: Column | None = None) -> DataFrame:
    """One column ``value``: each row as text, by default its only column or its JSON."""
    if by is None:
        by = F.col(f"`{df.columns[0]}`").cast("string") if len(df.columns) == 1 else F.to_json(F.struct("*"))
    return df.select(by.alias("value"))


def write_formatted(df: DataFrame, path: str, by: Column | None = None, compression: str = "none") -> None:
    """Write each row's text as a line, in as many files as there are partitions."""
    formatted(df, by).write.mode("overwrite").option("compression", compression).text(path)


def save_text(df: DataFrame, path: str, by: Column | None = None) -> int:
    """Write rows to one local file on the driver, streaming partition after partition; the number of lines."""
    n = 0
    with open(path, "w", encoding="utf-8") as out:
        for row in formatted(df, by).toLocalIterator():
            out.write(f"{row.value}\n")
            n += 1
    return n


def single_text_file(df: DataFrame, path: str, by: Column | None = None) -> None:
    """Write a directory with one part file; for results that one task can write."""
    formatted(df, by).coalesce(1).write.mode("overwrite").text(path)
