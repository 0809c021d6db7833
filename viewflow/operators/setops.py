"""Unions and differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def union(*inputs: DataFrame) -> DataFrame:
    """All rows, each once, duplicates within an input removed as well."""
    return union_all(*inputs).distinct()


def union_all(*inputs: DataFrame) -> DataFrame:
    """All rows as often as they come; columns go by position."""
    return reduce(DataFrame.union, inputs)


def distinct(df: DataFrame) -> DataFrame:
    """Each row once; null is a row like any other."""
    return df.distinct()


def subtract(left: DataFrame, right: DataFrame, keep_duplicates: bool = False) -> DataFrame:
    """Rows of ``left`` that aren't in ``right``."""
    return left.exceptAll(right) if keep_duplicates else left.subtract(right)
