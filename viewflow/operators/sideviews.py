"""Side views: small relations that every row gets to see.

Nothing is broadcast unchecked: a side view is computed once, up to the limit, and its rows and bytes are counted; a
larger one is refused or joined by shuffling instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import checkpointed
from .columns import By, expressions, one

LIMIT, BYTES = 1_000_000, 64 << 20


def measured(side: DataFrame, limit: int = LIMIT, most_bytes: int = BYTES) -> tuple[DataFrame, bool]:
    """(relation, whether it has at most ``limit`` rows and ``most_bytes`` of values).

    No more than ``limit`` rows are computed; if that is all of them, the relation returned is what was computed.
    """
    some = checkpointed(side.limit(limit + 1))
    n, size = some.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length(F.to_json(F.struct("*")))), F.lit(0))).first()
    return (some, size <= most_bytes) if n <= limit else (side, False)


def only_row(side: DataFrame, name: str = "side") -> DataFrame:
    """One row with the struct of a relation's single row, null if there is none; more rows raise an error."""
    row = F.struct(*[F.col(f"`{c}`") for c in side.columns])
    summed = side.limit(2).agg(F.first(row).alias(name), F.count(F.lit(1)).alias("_n"))
    checked = F.when(F.col("_n") > 1, F.raise_error(F.lit("a side view of one row has more")).cast(side.select(row.alias("r")).schema["r"].dataType)).otherwise(F.col(name))
    return summed.select(checked.alias(name))


def augment(df: DataFrame, *sides: DataFrame, names: list[str] | None = None, loaded_by: Column | None = None, limit: int = 10_000) -> DataFrame:
    """Every row beside what the side views hold: an array of each one's rows, or ``loaded_by`` of these arrays."""
    names = names or (["side"] if len(sides) == 1 else [f"side{k + 1}" for k in range(len(sides))])
    out = df
    for name, side in zip(names, sides, strict=True):
        side, small = measured(side, limit)
        if not small:
            raise ValueError(f"side view {name} has over {limit} rows or {BYTES} bytes; join it instead")
        out = out.crossJoin(F.broadcast(side.agg(F.sort_array(F.collect_list(F.struct("*"))).alias(name))))  # one row
    return out if loaded_by is None else out.withColumn(names[0] if len(names) == 1 else "side", loaded_by).drop(*names[1:])


def augment_row(df: DataFrame, side: DataFrame, name: str = "side") -> DataFrame:
    """Every row beside the side view's only one."""
    return df.crossJoin(F.broadcast(only_row(side, name)))


def augment_lookup(df: DataFrame, side: DataFrame, key: Column | str, side_key: str, value: str, name: str = "looked_up", strict: bool = False, limit: int = LIMIT) -> DataFrame:
    """Every row beside ``side``'s value for its key; with ``strict`` a missing key raises, else it gives null.

    Beyond ``limit`` rows or BYTES the side is joined by shuffling.
    """
    side, small = measured(side, limit)
    table = side.select(F.col(side_key).alias("_sk"), F.col(value).alias("_sv"), F.lit(True).alias("_there"))
    out = df.withColumn("_dk", one(key)).join(F.broadcast(table) if small else table, F.col("_dk").eqNullSafe(F.col("_sk")), "left")
    found = F.col("_sv")
    if strict:
        found = F.when(F.col("_there"), found).otherwise(F.raise_error(F.lit("a key is missing in the side view")).cast(table.schema["_sv"].dataType))
    return out.withColumn(name, found).drop("_dk", "_sk", "_sv", "_there")


def mapside_join(large: DataFrame, small: DataFrame, by: By, small_by: By, last: list[Column], limit: int = LIMIT) -> DataFrame:
    """Structs large and small for rows with equal keys; of several small rows of a key, the last in ``last`` counts."""
    keys = expressions(small, small_by)
    row = F.struct(*[F.col(f"`{c}`") for c in small.columns]).alias("small")
    ranked = small.select(row, *[c.alias(f"_s{k}") for k, c in enumerate(keys)], F.row_number().over(Window.partitionBy(*keys).orderBy(*[_reversed(c) for c in last])).alias("_rank"))
    one_each, fits = measured(ranked.where("_rank = 1").drop("_rank"), limit)
    left = large.select(F.struct(*[F.col(f"`{c}`") for c in large.columns]).alias("large"), *[c.alias(f"_l{k}") for k, c in enumerate(expressions(large, by))])
    on = [F.col(f"_l{k}").eqNullSafe(F.col(f"_s{k}")) for k in range(len(keys))]
    return left.join(F.broadcast(one_each) if fits else one_each, on).select("large", "small")


def _reversed(c: Column | str) -> Column:
    return one(c).desc()
