"""Readers. Each returns a DataFrame and reads nothing before an action."""

from __future__ import annotations

import csv
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import make_importable


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """One row ``value`` for each line of text files, directories or globs; line ends are left out."""
    _inside(paths)
    return spark.read.text(list(paths))


def _numbered_lines(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, split, at, value): lines with where they stand, by the split of the file and the order within it."""
    lines = spark.read.option("lineSep", "\n").text(list(paths))
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value")


#: Spark's names for what Python's csv module calls otherwise.
_CSV_NAMES = {"sep": "delimiter", "quote": "quotechar", "escape": "escapechar"}


def read_csv(spark: SparkSession, *paths: str, columns: int | None = None, multiline: bool = True, **options) -> DataFrame:
    """One row ``value`` (array of strings) for each record, by Python's csv module: no header, no inference.

    ``options`` are the module's. Quoted line ends and doubled quotes belong to their field, empty fields are empty
    strings, a blank line is an empty record, and records may differ in width. With ``columns`` given, shorter ones are
    filled up with nulls and a longer one raises. A file's lines go to one task in order and pass through it in a
    stream; for large files without quoted line ends ``multiline=False`` reads all splits of a file at once.
    """
    _inside(paths)
    named = {_CSV_NAMES.get(k, k): v for k, v in options.items()}
    csv.reader([], **named)  # unknown options raise here
    lines = _numbered_lines(make_importable(spark), paths)
    if multiline:
        lines = lines.repartition("path").sortWithinPartitions("path", "split", "at")
    return lines.select("path", "value").mapInArrow(lambda b: _records(b, columns, named), "value array<string>")


def _records(batches: Iterator[pa.RecordBatch], columns: int | None, named: dict, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    csv.field_size_limit(1 << 31)
    lines = (pair for b in batches for pair in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
    held = []
    batch = lambda: pa.RecordBatch.from_arrays([pa.array(held, pa.list_(pa.string()))], ["value"])
    for path, group in groupby(lines, key=lambda x: x[0]):
        for record in csv.reader((value + "\n" for _, value in group), **named):
            if columns and len(record) > columns:
                raise ValueError(f"a record of {path} has {len(record)} fields, over {columns}")
            held.append(record + [None] * (columns - len(record)) if columns else record)
            if len(held) == size:
                yield batch()
                held.clear()
    if held:
        yield batch()


def read_blocks(spark: SparkSession, *paths: str, is_end: Callable[[str], bool] | None = None) -> DataFrame:
    """Rows (path, block, lines): the lines up to each separator line, a blank one unless ``is_end`` says otherwise.

    Every separator ends a block, so two in a row leave an empty one between them, and one at the beginning ends an
    empty one; lines after the last separator are a block too. A final line end begins no further line. All splits of
    a file are read at once; sums of their separators tell each one the number of its first block. A Python ``is_end``
    sees each line without its end.
    """
    _inside(paths)
    lines = _numbered_lines(make_importable(spark), paths)
    if is_end is None:
        lines = lines.withColumn("ends", F.col("value") == "")
    else:
        lines = lines.mapInArrow(lambda b: _ends(b, is_end), "path string, split long, at long, value string, ends boolean")
    one = F.col("ends").cast("long")
    before = Window.partitionBy("path", "split").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    splits = lines.groupBy("path", "split").agg(F.sum(one).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = splits.select("path", "split", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    numbered = lines.withColumn("own", F.coalesce(F.sum(one).over(before), F.lit(0))).join(starts, ["path", "split"])
    held = F.collect_list(F.when(~F.col("ends"), F.struct("split", "at", "value")))
    grouped = numbered.groupBy("path", (F.col("start") + F.col("own")).cast("int").alias("block")).agg(F.sort_array(held).alias("l"))
    return grouped.select("path", "block", F.transform("l", lambda x: x["value"]).alias("lines"))


def _ends(batches: Iterator[pa.RecordBatch], is_end: Callable[[str], bool]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array([bool(is_end(x)) for x in b.column("value").to_pylist()], pa.bool_())], [*b.schema.names, "ends"])


def whole_text_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Rows (path, value): a file's whole text."""
    _inside(paths)
    return spark.read.text(list(paths), wholetext=True).select(F.input_file_name().alias("path"), "value")


def from_rows(spark: SparkSession, rows: Iterable, schema: str) -> DataFrame:
    """A relation of rows at hand; a schema of one type makes the column ``value``."""
    return spark.createDataFrame(list(rows), schema)


def reuse(spark: SparkSession, path: str) -> DataFrame:
    """A relation that store_rows() wrote; raises if there is none."""
    return spark.read.parquet(path)


def _inside(paths: Iterable[str]) -> None:
    for p in paths:
        if ".." in p.split("/"):
            raise ValueError(f"a path must not lead upwards: {p}")
