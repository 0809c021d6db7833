"""What a group becomes: lists, counts, sums, and folds."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class Reducer:
    """Turns the values of a group into one; ``column(value)`` is the Spark aggregate."""

    def column(self, value: Column) -> Column:
        raise NotImplementedError


class ReduceToCount(Reducer):
    """How many rows, nulls included."""

    def column(self, value: Column) -> Column:
        return F.count(F.lit(1))


class ReduceToSum(Reducer):
    """The sum, 0 if there is nothing to add; nulls are passed over."""

    def column(self, value: Column) -> Column:
        return F.coalesce(F.sum(value), F.lit(0))


class ReduceToList(Reducer):
    """All values in ascending order (a group has none of its own). It holds a group in memory: prefer other reducers."""

    def column(self, value: Column) -> Column:
        return F.sort_array(F.collect_list(value))


class ReduceTo(Reducer):
    """A fold from ``zero`` by ``step(accumulator, value)`` over columns.

    ``step`` sees Spark columns. A fold that adds, one whose step is the accumulator plus something that doesn't
    depend on it, should be given as ``ReduceTo.adding(zero, of)``: that is a sum, with partial sums before the
    shuffle. Others fold the group's values in ascending order, so that results don't depend on the partitions.
    """

    def __init__(self, zero: Any, step: Callable[[Column, Column], Column], finish: Callable[[Column], Column] | None = None):
        self.zero, self.step, self.finish = zero, step, finish

    @staticmethod
    def adding(zero: float, of: Callable[[Column], Column] = lambda v: v) -> Reducer:
        """zero + the sum of ``of(value)``."""
        return _Adding(zero, of)

    @staticmethod
    def aggregate(of: Callable[[Column], Column]) -> Reducer:
        """Any Spark aggregate of the value."""
        return _Aggregate(of)

    def column(self, value: Column) -> Column:
        zero = self.zero if isinstance(self.zero, Column) else F.lit(self.zero)
        held = F.sort_array(F.collect_list(value))
        return F.aggregate(held, zero, self.step, self.finish) if self.finish else F.aggregate(held, zero, self.step)


class _Adding(Reducer):
    def __init__(self, zero, of):
        self.zero, self.of = zero, of

    def column(self, value: Column) -> Column:
        return F.lit(self.zero) + F.coalesce(F.sum(self.of(value)), F.lit(0))


class _Aggregate(Reducer):
    def __init__(self, of):
        self.of = of

    def column(self, value: Column) -> Column:
        return self.of(value)
