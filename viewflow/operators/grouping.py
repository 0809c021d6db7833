"""Grouping. Null is a key like any other."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .columns import By, as_batches, expressions, keyed, one
from .reducers import Reducer, ReduceToCount, ReduceToList, ReduceToSum


def group(df: DataFrame, by: By = None, reducing: Reducer | None = None, retaining: By = None, combining: Reducer | None = None, name: str = "value") -> DataFrame:
    """(key columns, value) for each group of rows with equal ``by``.

    ``retaining`` picks what of a row is reduced, before the shuffle; the whole row by default. ``combining`` is only
    a hint: Spark combines before the shuffle wherever the reducer allows it.
    """
    del combining
    keys = keyed(df, by)
    kept = expressions(df, retaining)
    value = kept[0] if len(kept) == 1 else F.struct(*kept)
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg((reducing or ReduceToList()).column(value).alias(name))


def fold_rows(df: DataFrame, by: By, zero: Callable[[], Any], step: Callable[[Any, Any], Any], schema: str, order: By = None) -> DataFrame:
    """(key columns, value): a Python fold over each group's rows in the order of ``order``.

    Groups pass by in a stream, sorted in Spark, so none of them is held in memory. ``schema`` is the value's type.
    """
    keys = keyed(df, by)
    width, make = len(keys), df.columns
    staged = df.select(*[c.alias(f"_k{k}") for k, c in enumerate(keys.values())], *[F.col(f"`{c}`") for c in make])
    names = [f"_k{k}" for k in range(width)]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged.repartition(n, *names).sortWithinPartitions(*names, *expressions(df, order))
    out = StructType([*staged.select(*[F.col(k).alias(n) for k, n in zip(names, keys, strict=True)]).schema, *StructType.fromDDL(f"value {schema}")])
    single = len(make) == 1

    def rows(batches) -> Iterator[tuple]:
        key, acc, began = None, None, False
        for b in batches:
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if not began or r[:width] != key:
                    if began:
                        yield (*key, acc)
                    key, acc, began = r[:width], zero(), True
                acc = step(acc, r[width] if single else r[width:])
        if began:
            yield (*key, acc)

    return dealt.mapInArrow(lambda b: as_batches(rows(b), out), out)


def group_by_key(df: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """Pairs to (key, array of values)."""
    return group(df, key, ReduceToList(), retaining=value)


def reduce_by_key(df: DataFrame, reducing: Reducer | None = None, key: str = "key", value: str = "value") -> DataFrame:
    """Pairs to (key, reduced value)."""
    return group(df, key, reducing or ReduceToSum(), retaining=value)


def count_by_key(df: DataFrame, key: str = "key") -> DataFrame:
    """Pairs to (key, number of pairs), as a relation."""
    return group(df, key, ReduceToCount())


def count_distinct_per_key(df: DataFrame, by: By, of: Column | str, name: str = "value") -> DataFrame:
    """(key columns, number of different non-null values of ``of``)."""
    keys = keyed(df, by)
    return df.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(F.countDistinct(one(of)).alias(name))


def top_k_per_group(df: DataFrame, by: By, order: list[Column], k: int) -> DataFrame:
    """The first k rows of each group in ``order``, which should end in something unique."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*expressions(df, by)).orderBy(*order)))
    return ranked.where(F.col("_rank") <= k).drop("_rank")
