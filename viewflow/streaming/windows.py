"""Event-time aggregation over streams of (time, key, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def by_window(events: DataFrame, time: str, keys: list[str], size: str, late: str, slide: str | None = None) -> DataFrame:
    """(start, keys, n) for tumbling windows, or sliding ones; events later than ``late`` may be dropped."""
    marked = events.withWatermark(time, late)
    counted = marked.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), *keys, "n")


def by_session(events: DataFrame, time: str, keys: list[str], gap: str, late: str) -> DataFrame:
    """(start, end, keys, n) for sessions that a pause of ``gap`` ends."""
    counted = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "n")


def first_of_each(events: DataFrame, time: str, keys: list[str], late: str) -> DataFrame:
    """Each key once within the watermark: distinct on a stream."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now, exactly once into Parquet at ``path``; the table.

    In complete mode each batch replaces the table, so that it ends as the state of all groups.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").outputMode("append").start(path)
    else:
        query = writer.outputMode(mode).foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(path)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)
