"""Counting words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import operators as ops
from ..functions import words


def word_count(texts: DataFrame, text: str = "text", prefix: str = "") -> DataFrame:
    """(word, n) over all texts, lower-cased; with ``prefix`` of the words that begin so."""
    tokens = ops.flatten(texts, words(text), name="word")
    if prefix:
        tokens = tokens.where(F.startswith("word", F.lit(prefix)))
    return ops.group(tokens, "word", ops.ReduceToCount(), name="n")


def common_words(texts: DataFrame, least: int = 200, text: str = "text") -> DataFrame:
    """(n, words): the words of each count from ``least`` on."""
    return ops.group(word_count(texts, text).where(F.col("n") >= least), "n", ops.ReduceToList(), retaining="word", name="words")


def prefix_count(texts: DataFrame, length: int = 1, text: str = "text") -> DataFrame:
    """(prefix, n): occurrences of words by their first characters."""
    return ops.group(word_count(texts, text), {"prefix": F.substring("word", 1, length)}, ops.ReduceToSum(), retaining="n", name="n")


def word_probability(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, p): a word's share of all occurrences."""
    counts = word_count(texts, text)
    total = counts.agg(F.sum("n").alias("total"))
    return ops.sideviews.augment_row(counts, total).select("word", (F.col("n") / F.col("side.total")).alias("p"))


def word_compare(blue: DataFrame, red: DataFrame, text: str = "text") -> DataFrame:
    """(word, score) of words in both corpora: ln((n1 + 1) / (n1 + n2 + 2))."""
    joined = ops.join(ops.JoinInput(word_count(blue, text), "word"), ops.JoinInput(word_count(red, text), "word"))
    n1, n2 = F.col("_1.n"), F.col("_2.n")
    return joined.select(F.col("_1.word").alias("word"), F.ln((n1 + 1.0) / (n1 + n2 + 2.0)).alias("score"))


def sum_events(lines: DataFrame, event: Column, count: Column) -> DataFrame:
    """(event, n) sums of counts given as text; lines whose count is no number are left out."""
    read = lines.select(event.alias("event"), count.try_cast("long").alias("n")).where("event is not null and n is not null")
    return ops.group(read, "event", ops.ReduceToSum(), retaining="n", name="n")


def normalised_lines(texts: DataFrame, order: ops.columns.By, classes: str, text: str = "text", name: str = "rcv%06d.txt", start: int = 1) -> DataFrame:
    """(value): a line for each text in the order of ``order``: a name made from its number, its classes and its
    lower-cased words, parted by tabs."""
    numbered = ops.number_rows(texts, order, "_n", start)
    parts = F.concat(F.array(F.format_string(name, "_n"), F.coalesce(F.col(classes).cast("string"), F.lit(""))), F.coalesce(words(text), F.array().cast("array<string>")))
    return numbered.select(F.array_join(parts, "\t").alias("value"))
