"""Rows through external commands, as lines."""

from __future__ import annotations

import subprocess
import threading
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import one


def pipe(df: DataFrame, command: str, by: Column | str | None = None) -> DataFrame:
    """(value): the lines that a shell command writes, run once for each partition with its rows as lines.

    ``by`` is a row's line, by default its only column; nulls are empty lines. Lines stream in and out, so nothing is
    held. A command that fails fails its task, and Spark tries again, so it should have no other effects.
    """
    line = one(by) if by is not None else F.col(f"`{df.columns[0]}`")
    lines = df.select(F.coalesce(line.cast("string"), F.lit("")).alias("value"))
    return lines.mapInArrow(lambda batches: _run(batches, command), "value string")


def map_reduce(df: DataFrame, mapper: str, reducer: str, by: Column | str | None = None, partitions: int | None = None) -> DataFrame:
    """(value): the lines of a reducing command that gets a mapping command's lines, sorted, all of one key in one run.

    A line's key is what stands before its first tab. Equal lines are counted, sorted as one, and written out as often as
    they come, so what a key's task holds grows with its different lines.
    """
    mapped = pipe(df, mapper, by).groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("key", F.substring_index("value", "\t", 1))
    dealt = mapped.repartition(partitions, "key") if partitions else mapped.repartition("key")
    lines = dealt.sortWithinPartitions("key", "value").select("value", "n")
    return lines.mapInArrow(lambda batches: _run(batches, reducer), "value string")


def _run(batches: Iterator[pa.RecordBatch], command: str, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    running = subprocess.Popen(command, shell=True, stdin=subprocess.PIPE, stdout=subprocess.PIPE)
    failed: list[BaseException] = []

    def feed():
        try:
            with running.stdin as to:
                for b in batches:
                    if b.num_columns == 1:
                        to.write("".join(f"{x}\n" for x in b.column(0).to_pylist()).encode())
                        continue
                    for x, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):  # a line and how often it comes
                        line = f"{x}\n".encode()
                        at_once = max(1, (1 << 16) // len(line))
                        for _ in range(n // at_once):
                            to.write(line * at_once)
                        to.write(line * (n % at_once))
        except BrokenPipeError:  # the command has read enough
            return
        except BaseException as e:
            failed.append(e)

    writer = threading.Thread(target=feed, daemon=True)
    writer.start()
    held = []
    for line in running.stdout:
        held.append(line.decode().removesuffix("\n"))
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
            held = []
    writer.join()
    if failed:
        raise failed[0]
    if running.wait():
        raise RuntimeError(f"{command} ended with {running.returncode}")
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
