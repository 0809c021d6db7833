"""Storage that the driver and every executor can see, and small plan helpers."""

from __future__ import annotations

import atexit
import contextlib
import math
import posixpath
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names.

    Where it is unset, a local session (a test) gets a temporary folder of its own;
    any other master is refused, since a machine-local folder is not shared there.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    made = "file://" + tempfile.mkdtemp(prefix="viewflow-")
    spark.conf.set("spark.checkpoint.dir", made)
    spark.sparkContext.setCheckpointDir(made)
    return made


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call gets; removed when the session's process ends."""
    path = posixpath.join(shared_dir(spark), f"viewflow-{name}-{uuid.uuid4().hex}")
    if not _written:
        atexit.register(_remove_all)
    _written.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that new_path() named."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _written:
        _written.remove(path)


def _remove_all() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for path in list(_written):
        try:
            remove(spark, path)
        except Exception:  # the JVM is going away as well; what is left is only a temporary folder
            return


def write_table(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Write ``df`` as Parquet in the shared folder; the table read back, and its path. This cuts lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def map_arrow(df: DataFrame, fn: Callable[[Iterator], Iterator], schema: str | StructType, tokenizes: bool = False) -> DataFrame:
    """mapInArrow whose workers give memory back: unused Arrow and heap pages when a task ends, and the tokenizers'
    memos when a task begins that doesn't tokenize. Workers outlive tasks, so else every operator's peak adds up."""

    def run(batches: Iterator) -> Iterator:
        memos = sys.modules.get("viewflow.llm.tokens")
        if memos and not tokenizes:
            memos.forget()
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Return this process's unused memory to the system, where the C library knows how to."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def filesystem(uri: str):
    """(pyarrow file system, path) for a URI or plain path; works on driver and executors."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def partitions_for(df: DataFrame, target_bytes: int = 32 << 20) -> int:
    """How many partitions keep one near ``target_bytes`` of input, and spark.sql.shuffle.partitions at least.

    200,000 at most, as many bounds of ranges as the driver can hold: from 6 TB on, partitions grow instead.
    """
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(200_000, math.ceil(size / target_bytes))) if size < 1 << 55 else least


def range_bounds(df: DataFrame, column: str, n: int) -> list[int]:
    """n - 1 ascending split points of a numeric column, from Spark's mergeable quantile sketch; a value that many rows
    have stands there several times. An empty table has none."""
    if n < 2:
        return []
    found = df.select(column).approxQuantile(column, [i / n for i in range(1, n)], min(0.001, 0.25 / n))
    return sorted(int(x) for x in found)
