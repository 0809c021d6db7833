"""Joins. A row of the result holds whole rows side by side, and null keys match each other."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import By, expressions

_COPIES = 1 << 16
HOW = {(False, False): "inner", (True, False): "left", (False, True): "right", (True, True): "full"}


@dataclass(frozen=True)
class JoinInput:
    """One side of a join: a relation, its key (the whole row by default), and whether unmatched rows stay."""

    rows: DataFrame
    by: By = None
    outer: bool = False


def _side(given: JoinInput | DataFrame, k: int) -> tuple[DataFrame, int]:
    given = given if isinstance(given, JoinInput) else JoinInput(given)
    keys = expressions(given.rows, given.by)
    kept = F.struct(*[F.col(f"`{c}`") for c in given.rows.columns]).alias(f"_{k}")
    return given.rows.select(kept, *[c.alias(f"_k{k}_{i}") for i, c in enumerate(keys)]), len(keys)


def _equal(a: int, b: int, n: int) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"_k{a}_{i}").eqNullSafe(F.col(f"_k{b}_{i}")) for i in range(n)])


def join(*inputs: JoinInput | DataFrame) -> DataFrame:
    """Structs _1, _2 ... for each combination of rows with equal keys; an outer side's unmatched rows face nulls.

    Any number of inner inputs; with outer ones there have to be two.
    """
    outer = [isinstance(x, JoinInput) and x.outer for x in inputs]
    if len(inputs) < 2:
        raise ValueError("a join has two inputs at least")
    if any(outer) and len(inputs) != 2:
        raise ValueError("outer joins have two inputs")
    sides = [_side(x, k + 1) for k, x in enumerate(inputs)]
    if len({n for _, n in sides}) != 1:
        raise ValueError("the inputs' keys have different numbers of columns")
    n = sides[0][1]
    if len(inputs) > 2:
        return _product([side for side, _ in sides], n)
    return sides[0][0].join(sides[1][0], _equal(1, 2, n), HOW[outer[0], outer[1]]).select("_1", "_2")


def _product(sides: list[DataFrame], n: int, block: int = 256) -> DataFrame:
    """The product of each key's rows. A key's rows lie in blocks of about ``block``; blocks meet, and what meets is dealt
    out evenly before it is multiplied out, so neither a frequent key nor a large product is left to one task.

    A stage of generated code holds all rows that it makes of one row, so each block is multiplied in a stage of its own
    (``coalesce`` to the partitions that there are only ends the stage): held are a block's rows, not their product.
    """
    out, tasks = None, int(sides[0].sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for k, side in enumerate(sides, 1):
        keys = [f"_k{k}_{i}" for i in range(n)]
        counts = side.groupBy(*[F.col(c).alias(f"_c{i}") for i, c in enumerate(keys)]).agg(F.ceil(F.count(F.lit(1)) / block).alias("_blocks"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_c{i}")) for i, c in enumerate(keys)])
        dealt = side.withColumn("_at", F.monotonically_increasing_id()).join(counts, same)
        dealt = dealt.groupBy(*keys, F.pmod(F.xxhash64("_at"), "_blocks").alias("_block")).agg(F.collect_list(f"_{k}").alias(f"_b{k}")).drop("_block")
        out = dealt if out is None else out.join(dealt, _equal(1, k, n))
    out = out.select(*[f"_b{k + 1}" for k in range(len(sides))]).repartition(tasks)
    for k in range(1, len(sides) + 1):
        out = out if k == 1 else out.coalesce(tasks)
        out = out.select("*", F.explode(f"_b{k}").alias(f"_{k}")).drop(f"_b{k}")
    return out


def join_to(left: DataFrame, right: JoinInput, by: By = None) -> DataFrame:
    """A two-way join in the middle of a chain; only ``right`` can be outer."""
    return join(JoinInput(left, by), right)


def join_on_key(left: DataFrame, right: DataFrame, key: str = "key", value: str = "value", how: str = "inner") -> DataFrame:
    """Pairs and pairs to (key, left value, right value), the key once."""
    a = left.select(F.col(key).alias("_a"), F.col(value).alias("left_value"))
    b = right.select(F.col(key).alias("_b"), F.col(value).alias("right_value"))
    return a.join(b, F.col("_a").eqNullSafe(F.col("_b")), how).select(F.coalesce("_a", "_b").alias(key), "left_value", "right_value")


def _on_rows(left: DataFrame, right: DataFrame) -> Column:
    pairs = zip(left.columns, right.columns, strict=True)
    return reduce(lambda x, y: x & y, [F.col(f"l.`{a}`").eqNullSafe(F.col(f"r.`{b}`")) for a, b in pairs])


def intersection_bag(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both; a row m times here and n times there comes m * n times.

    Different rows meet once, with their numbers; copies are made after these have been dealt out in blocks.
    """
    once = left.groupBy(*[f"`{c}`" for c in left.columns]).agg(F.count(F.lit(1)).alias("_m"))
    other = right.groupBy(*[f"`{c}`" for c in right.columns]).agg(F.count(F.lit(1)).alias("_n"))
    both = once.alias("l").join(other.alias("r"), _on_rows(left, right)).select(*[F.col(f"l.`{c}`") for c in left.columns], (F.col("_m") * F.col("_n")).alias("_copies"))
    blocks = both.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / _COPIES))).alias("_block"))
    dealt = blocks.repartition(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    here = F.least(F.lit(_COPIES).cast("long"), F.col("_copies") - F.col("_block") * _COPIES).cast("int")
    copies = dealt.select(*[F.col(f"`{c}`") for c in left.columns], F.explode(F.sequence(F.lit(1), here)).alias("_copy"))
    return copies.select(*[F.col(f"`{c}`") for c in left.columns])


def intersection_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows in both, each once."""
    return left.intersect(right)


def semi_join(left: JoinInput, right: JoinInput) -> DataFrame:
    """Rows of ``left`` whose key is in ``right``."""
    return _half(left, right, "left_semi")


def anti_join(left: JoinInput, right: JoinInput) -> DataFrame:
    """Rows of ``left`` whose key isn't in ``right``."""
    return _half(left, right, "left_anti")


def _half(left: JoinInput, right: JoinInput, how: str) -> DataFrame:
    a, n = _side(left, 1)
    b, _ = _side(right, 2)
    return a.join(b.drop("_2"), _equal(1, 2, n), how).select("_1.*")
