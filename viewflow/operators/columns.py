"""How operators take keys and expressions: columns, names, SQL text, lists of these, or Python with a schema."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

By = Column | str | list | tuple | dict | None


def expressions(df: DataFrame, by: By) -> list[Column]:
    """The columns that ``by`` names; nothing named means all. A dict gives names to its columns."""
    if by is None:
        return [F.col(f"`{c}`") for c in df.columns]
    if isinstance(by, dict):
        return [one(c).alias(n) for n, c in by.items()]
    return [one(c) for c in by] if isinstance(by, list | tuple) else [one(by)]


def one(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.expr(c)


def keyed(df: DataFrame, by: By, prefix: str = "key") -> dict[str, Column]:
    """Key columns under names of their own: key, or key1, key2 ..., or the dict's."""
    if isinstance(by, dict):
        return {n: one(c) for n, c in by.items()}
    if isinstance(by, str) and by in df.columns:
        return {by: F.col(f"`{by}`")}
    if isinstance(by, list | tuple) and all(isinstance(c, str) and c in df.columns for c in by):
        return {c: F.col(f"`{c}`") for c in by}
    if by is None:
        return {c: F.col(f"`{c}`") for c in df.columns}
    cs = expressions(df, by)
    return {prefix if len(cs) == 1 else f"{prefix}{k + 1}": c for k, c in enumerate(cs)}


def as_batches(rows: Iterator[Any], schema: StructType, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    """Rows of Python values as Arrow batches; for a schema of one column bare values will do."""
    from pyspark.sql.pandas.types import to_arrow_schema

    kind, held = to_arrow_schema(schema), []

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(kind)], schema=kind)
        held.clear()
        return out

    for r in rows:
        held.append(r if isinstance(r, tuple | list) and (len(kind) > 1 or isinstance(r, Row)) else (r,))
        if len(held) == size:
            yield batch()
    if held:
        yield batch()


def python_rows(df: DataFrame, fn: Callable[[Iterator[Any]], Iterator[Any]], schema: str | StructType) -> DataFrame:
    """Run ``fn`` over each partition's rows in Python; a row of one column arrives as the bare value."""
    out = StructType.fromDDL(_ddl(schema)) if isinstance(schema, str) else schema
    make, single = Row(*df.columns), len(df.columns) == 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for b in batches:
                lists = [c.to_pylist() for c in b.columns]
                yield from lists[0] if single else (make(*r) for r in zip(*lists, strict=True))

        return as_batches(fn(rows()), out)

    return df.mapInArrow(run, out)


def _ddl(schema: str) -> str:
    head = schema.strip()
    return head if " " in head.split("<")[0].strip() or ":" in head.split("<")[0] else f"value {head}"
