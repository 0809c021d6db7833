"""Column functions that programs need and Spark has no single name for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def words(text: Column | str, lower: bool = True) -> Column:
    """Words of a text, separated by runs of ASCII white space; no empty ones."""
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c) if lower else c, r"[ \t\n\r\x0B\f]+"), "")


def fields(text: Column | str, separator: str = " ") -> Column:
    """Parts between single separators; empty parts stay."""
    c = F.col(text) if isinstance(text, str) else text
    return F.split(c, "\\Q" + separator + "\\E", -1)


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient rounded down, null for a zero divisor (SQL's div rounds toward zero)."""
    return F.floor(F.try_divide(a, b))


def safe_log(x: Column) -> Column:
    """Natural logarithm, null unless positive."""
    return F.when(x > 0, F.ln(x))


def truthy(df: DataFrame, column: str | None = None) -> Column:
    """Whether a value is neither null nor zero, empty or false; of several columns, whether the row is not null."""
    names = [column] if column else df.columns
    if len(names) != 1:
        return F.lit(True)
    c, kind = F.col(f"`{names[0]}`"), df.schema[names[0]].dataType
    if isinstance(kind, T.BooleanType):
        good = c
    elif isinstance(kind, T.NumericType):
        good = c != 0
    elif isinstance(kind, T.StringType):
        good = c != ""
    elif isinstance(kind, T.ArrayType | T.MapType):
        good = F.size(c) > 0
    else:
        good = c.isNotNull()
    return F.coalesce(good, F.lit(False))


def last_dropped(array: Column | str) -> Column:
    """An array without its last element."""
    c = F.col(array) if isinstance(array, str) else array
    return F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0)))


def top_k(array: Column, k: int) -> Column:
    """The k largest elements, largest first."""
    return F.slice(F.sort_array(array, asc=False), 1, k)
