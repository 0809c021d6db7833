"""A fluent form: a context makes relations, methods make new ones, actions compute."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce as fold
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .. import operators as ops
from .. import sources
from ..session import make_importable


class Context:
    """Makes relations and remembers them under tags."""

    def __init__(self, spark: SparkSession):
        self.spark, self._made = make_importable(spark), []

    def text_file(self, *paths: str) -> Rel:
        return self._keep("text_file", sources.read_lines(self.spark, *paths))

    def whole_text_files(self, *paths: str) -> Rel:
        return self._keep("whole_text_files", sources.whole_text_files(self.spark, *paths))

    def parallelize(self, rows, schema: str) -> Rel:
        return self._keep("parallelize", sources.from_rows(self.spark, rows, schema))

    def table(self, path: str) -> Rel:
        return self._keep("table", self.spark.read.parquet(path))

    def wrap(self, df: DataFrame) -> Rel:
        return self._keep("wrap", df)

    def list(self) -> list[str]:
        return [r.tag for r in self._made]

    def ship(self, path: str) -> None:
        """Send a Python file or archive to all workers."""
        (self.spark.sparkContext.addPyFile if path.endswith((".py", ".zip", ".egg")) else self.spark.sparkContext.addFile)(path)

    def _keep(self, what: str, df: DataFrame) -> Rel:
        made = Rel(self, f"{what}__{len(self._made) + 1}", df)
        self._made.append(made)
        return made


class Rel:
    """A relation. Pairs are relations with columns key and value."""

    def __init__(self, context: Context, tag: str, df: DataFrame):
        self.context, self.tag, self.df = context, tag, df

    def _new(self, what: str, df: DataFrame) -> Rel:
        return self.context._keep(what, df)

    def map(self, by, schema: str | None = None) -> Rel:
        return self._new("map", ops.replace_each(self.df, by, schema))

    def flat_map(self, by, schema: str | None = None, name: str = "value", keep: list[str] = ()) -> Rel:
        return self._new("flat_map", ops.flatten(self.df, by, schema, name, keep))

    def filter(self, by=None) -> Rel:
        return self._new("filter", ops.filter_rows(self.df, by))

    def map_partitions(self, by: Callable[[Iterator], Iterator], schema: str) -> Rel:
        return self._new("map_partitions", ops.replace_each_partition(self.df, by, schema))

    def pipe(self, command: str) -> Rel:
        return self._new("pipe", ops.pipe(self.df, command))

    def sample(self, with_replacement: bool, fraction: float, seed: int = 0) -> Rel:
        return self._new("sample", ops.sample(self.df, fraction, seed, with_replacement))

    def group_by_key(self) -> Rel:
        return self._new("group_by_key", ops.group_by_key(self.df))

    def reduce_by_key(self, reducing: ops.Reducer) -> Rel:
        return self._new("reduce_by_key", ops.reduce_by_key(self.df, reducing))

    def count_by_key(self) -> Rel:
        return self._new("count_by_key", ops.count_by_key(self.df))

    def distinct(self) -> Rel:
        return self._new("distinct", ops.distinct(self.df))

    def union(self, other: Rel) -> Rel:
        """Each row once."""
        return self._new("union", ops.union(self.df, other.df))

    def union_all(self, other: Rel) -> Rel:
        return self._new("union_all", ops.union_all(self.df, other.df))

    def intersection(self, other: Rel) -> Rel:
        """Rows in both as often as they pair up."""
        return self._new("intersection", ops.intersection_bag(self.df, other.df))

    def intersection_set(self, other: Rel) -> Rel:
        return self._new("intersection_set", ops.intersection_set(self.df, other.df))

    def subtract(self, other: Rel) -> Rel:
        return self._new("subtract", ops.subtract(self.df, other.df))

    def join(self, other: Rel, how: str = "inner") -> Rel:
        return self._new("join", ops.join_on_key(self.df, other.df, how=how))

    def cache(self) -> Rel:
        self.df = self.df.persist(StorageLevel.MEMORY_AND_DISK)
        return self

    def _values(self) -> Iterator[Any]:
        for row in self.df.toLocalIterator():
            yield row[0] if len(row) == 1 else row

    def collect(self) -> Iterator[Any]:
        """All rows, a partition at a time."""
        return self._values()

    def take(self, n: int) -> list[Any]:
        return [r[0] if len(r) == 1 else r for r in self.df.take(n)]

    def first(self) -> Any:
        """The first row, None if there is none."""
        return next(iter(self.take(1)), None)

    def foreach(self, fn: Callable[[Any], None]) -> None:
        """Call ``fn`` on the driver for every row."""
        for r in self._values():
            fn(r)

    def reduce(self, fn: Callable[[Any, Any], Any]) -> Any:
        """The rows folded by an associative, commutative function, partition by partition; None without rows."""
        row, kind = self.df.columns, self.df.schema

        def part(rows):
            held = list(fold_once(rows, fn))
            yield from held

        got = [r[0] if len(row) == 1 else r for r in ops.replace_each_partition(self.df, part, kind).collect()]  # a row for each partition
        return fold(fn, got) if got else None

    def count(self) -> int:
        return self.df.count()

    def save(self, path: str) -> int:
        return sources.save_text(self.df, path)

    def store(self, path: str) -> Rel:
        return self._new("store", sources.store_rows(self.df, path))

    def plan(self) -> str:
        return self.context.spark._jvm.PythonSQLUtils.explainString(self.df._jdf.queryExecution(), "formatted")

    def pprint(self) -> str:
        return self.df._jdf.queryExecution().logical().treeString()

    def steps(self) -> list[str]:
        return self.pprint().splitlines()

    def tasks(self) -> list[str]:
        return [x.strip() for x in self.df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x] or ["no shuffle"]


def fold_once(rows: Iterator[Any], fn: Callable[[Any, Any], Any]) -> Iterator[Any]:
    """The fold of what an iterator yields, if it yields anything."""
    for first in rows:
        yield fold(fn, rows, first)


def pairs(df: DataFrame, key, value) -> DataFrame:
    """Columns key and value."""
    one = ops.columns.one
    return df.select(one(key).alias("key"), one(value).alias("value"))


__all__ = ["Context", "F", "Rel", "Row", "pairs"]
