"""Per-row and per-partition operators."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import truthy
from ..session import checkpointed
from .columns import By, expressions, python_rows

log = logging.getLogger("viewflow")


def replace_each(df: DataFrame, by: By | Callable = None, schema: str | StructType | None = None) -> DataFrame:
    """One row for each row: columns that ``by`` names, or a Python function's value under ``schema``."""
    if callable(by) and not isinstance(by, Column):
        return python_rows(df, lambda rows, f=by: map(f, rows), _needed(schema))
    return df.select(*expressions(df, by))


def flatten(df: DataFrame, by: Column | str | Callable | None = None, schema: str | StructType | None = None, name: str = "value", keep: list[str] = ()) -> DataFrame:
    """A row for each element of the array, or entry of the map, that ``by`` gives; none for null or empty ones.

    Elements that are structs become columns. ``keep`` names columns to repeat beside each element.
    """
    if callable(by) and not isinstance(by, Column):
        return python_rows(df, lambda rows, f=by: (x for r in rows for x in f(r)), _needed(schema))
    c = expressions(df, by)[0]
    kept = [F.col(f"`{k}`") for k in keep]
    kind = df.select(c.alias("c")).schema["c"].dataType
    if isinstance(kind, MapType):
        return df.select(*kept, F.explode(c))
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType):
        return df.select(*kept, F.inline(c))
    return df.select(*kept, F.explode(c).alias(name))


def filter_rows(df: DataFrame, by: Column | str | Callable | None = None) -> DataFrame:
    """Rows for which ``by`` is true; without it rows that are neither null nor zero, empty or false."""
    if by is None:
        return df.where(truthy(df))
    if callable(by) and not isinstance(by, Column):
        return python_rows(df, lambda rows, f=by: (r for r in rows if f(r)), df.schema)
    return df.where(by)


def replace_each_partition(df: DataFrame, by: Callable[[Iterator[Any]], Iterator[Any]], schema: str | StructType) -> DataFrame:
    """What a generator makes of each partition's rows; its state starts anew in every partition."""
    return python_rows(df, by, schema)


def sample(df: DataFrame, fraction: float, seed: int, with_replacement: bool = False) -> DataFrame:
    """Each row by chance; the same seed gives the same rows of the same partitions."""
    return df.sample(with_replacement, fraction, seed)


def number_rows(df: DataFrame, by: By, name: str = "row_id", start: int = 0) -> DataFrame:
    """Consecutive numbers in the order of ``by``, over all rows, without taking them all to one task.

    Rows are range-partitioned and sorted; each partition's count gives where the next one starts.
    """
    spark = df.sparkSession
    ordered = df.repartitionByRange(*expressions(df, by)).sortWithinPartitions(*expressions(df, by))
    local = checkpointed(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = {r["_part"]: r["n"] for r in local.groupBy("_part").agg(F.count("*").alias("n")).collect()}  # a row for each partition
    total, before = start, []
    for part in sorted(sizes):
        before.append((part, total))
        total += sizes[part]
    bases = spark.createDataFrame(before or [(0, start)], "_part int, _base long")
    return local.join(F.broadcast(bases), "_part").select(*df.columns, (F.col("_base") + F.col("_at")).alias(name))


def running_sum(df: DataFrame, value: Column | str, by: By, name: str = "running", within: By | None = None) -> DataFrame:
    """Sums of ``value`` up to each row in the order of ``by``, within groups, or over all rows.

    Over all rows: sums up within ranges of the order, where each range lies, and adds the totals of the ranges before;
    nulls count as zero.
    """
    v = F.expr(value) if isinstance(value, str) else value
    rows = (Window.unboundedPreceding, 0)
    if within is not None:
        order = Window.partitionBy(*expressions(df, within)).orderBy(*expressions(df, by)).rowsBetween(*rows)
        return df.withColumn(name, F.sum(v).over(order))
    own = df.withColumn("_v", v)
    kind = own.select(F.sum("_v").alias("s")).schema["s"].dataType
    ranged = own.withColumn("_v", F.col("_v").cast(kind)).repartitionByRange(*expressions(df, by)).sortWithinPartitions(*expressions(df, by)).withColumn("_part", F.spark_partition_id())
    local = checkpointed(ranged.mapInArrow(_sum_up, StructType([*ranged.schema, StructField("_own", kind)])))
    totals = local.groupBy("_part").agg(F.sum("_v").alias("_sum"))
    starts = totals.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))  # a row for each partition
    return local.join(F.broadcast(starts), "_part").select(*df.columns, (F.col("_start") + F.col("_own")).alias(name))


def _sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches with running sums of _v, nulls counting as zero."""
    carried = None
    for b in batches:
        sums = b.column("_v").fill_null(0)
        if len(sums):
            sums = pc.cumulative_sum(sums) if carried is None else pc.cumulative_sum(sums, start=carried)
            sums = sums.cast(b.column("_v").type)
            carried = sums[-1]
        yield pa.RecordBatch.from_arrays([*b.columns, sums], [*b.schema.names, "_own"])


def log_rows(df: DataFrame, logfun: Callable[[Any, int], None]) -> DataFrame:
    """The same rows; ``logfun(row, i)`` is called on the workers for each, i counting from 0 in each partition."""

    def run(rows):
        for i, r in enumerate(rows):
            logfun(r, i)
            yield r

    return python_rows(df, run, df.schema)


def log_echo_first(df: DataFrame, first: int = 10) -> DataFrame:
    """The same rows; each partition's first ones are logged."""
    return log_rows(df, lambda r, i: log.warning("row %d: %r", i, r) if i < first else None)


def log_progress(df: DataFrame, message: str, interval: int = 1000) -> DataFrame:
    """The same rows; a message is logged for every ``interval`` of them in a partition."""
    return log_rows(df, lambda r, i: log.warning("%s: %d rows", message, i + 1) if (i + 1) % interval == 0 else None)


def _needed(schema):
    if schema is None:
        raise TypeError("a Python function needs a schema for what it returns")
    return schema
