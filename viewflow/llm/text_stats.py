"""Per-document statistics as Spark expressions: no Python on the executors.

Every step is a projection of its own, so an array that a lambda looks into is there already and isn't made again
for each element.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Shares and means that rules and models look at; each lies in a plain range whatever the text's length.
FEATURES = ("words", "word_length", "symbols", "dup_lines", "repeats", "distinct", "capitals", "marks", "line_words", "digits")


def with_statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the COUNTS and FEATURES of each whole text; null texts count as empty.

    A word is a run of characters other than 0x20 and 0x09-0x0D. n_dup_lines: lines with a word that equal an earlier
    line. n_repeat_words: words in windows of eight words that stand in the text twice or more, the first included.
    Columns of ``docs`` with these names are replaced.
    """
    p = "_vf_"  # what the helper columns begin with, and no column of ``docs`` does
    while any(c.lower().startswith(p) for c in docs.columns):
        p += "_"
    at = lambda array, k: F.get(F.col(p + array), k)
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    out = docs.drop(*COUNTS, *(f"f_{x}" for x in FEATURES)).withColumn(p + "text", text)
    bare = F.btrim(p + "text", F.lit(SPACES))
    no_words = F.array().cast("array<string>")
    out = out.withColumn(p + "words", F.when(bare == "", no_words).otherwise(F.split(bare, r"[\x20\x09-\x0D]+")))
    lines = F.filter(F.split(p + "text", "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    out = out.withColumns({p + "lines": lines, p + "hash": F.transform(p + "words", lambda w: F.xxhash64(w)), "n_words": F.size(p + "words").cast("long")})
    window = F.transform(F.sequence(F.lit(0), F.size(p + "hash") - WINDOW), lambda i: F.xxhash64(*[at("hash", i + k) for k in range(WINDOW)]))
    out = out.withColumns({
        "word_chars": F.length(F.regexp_replace(p + "text", r"[\x20\x09-\x0D]+", "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(p + "text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(p + "lines") - F.size(F.array_distinct(p + "lines"))).cast("long"),
        p + "capitals": F.length(F.regexp_replace(p + "text", r"[^A-Z]+", "")),
        p + "marks": F.length(F.regexp_replace(p + "text", r"[^!?.,;:]+", "")),
        p + "digits": F.length(F.regexp_replace(p + "text", r"[^0-9]+", "")),
        p + "distinct": F.size(F.array_distinct(p + "hash")),
        p + "line_count": F.size(p + "lines"),
        p + "windows": F.when(F.col("n_words") >= WINDOW, window).otherwise(F.array().cast("array<bigint>")),
    }).drop(p + "text", p + "words", p + "lines", p + "hash")
    twice = F.size(F.array_distinct(p + "windows")) < F.size(p + "windows")
    placed = F.sort_array(F.transform(p + "windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn(p + "sorted", F.when(twice, placed)).drop(p + "windows")
    same = lambda x, k: F.coalesce(at("sorted", k)["h"] == x["h"], F.lit(False))
    found = F.filter(p + "sorted", lambda x, k: same(x, k - 1) | same(x, k + 1))
    out = out.withColumn(p + "places", F.sort_array(F.transform(found, lambda x: x["i"]))).drop(p + "sorted")
    covered = F.transform(p + "places", lambda x, k: F.least(F.lit(WINDOW), F.coalesce(at("places", k + 1) - x, F.lit(WINDOW))))
    out = out.withColumn("n_repeat_words", F.coalesce(F.aggregate(covered, F.lit(0), lambda a, b: a + b), F.lit(0)).cast("long")).drop(p + "places")
    words, chars, count = (F.greatest(F.col(c), F.lit(1)).cast("double") for c in ("n_words", "word_chars", p + "line_count"))
    features = {
        "words": F.log1p("n_words"),
        "word_length": F.col("word_chars") / words,
        "symbols": F.col("n_symbols") / chars,
        "dup_lines": F.col("n_dup_lines") / count,
        "repeats": F.col("n_repeat_words") / words,
        "distinct": F.col(p + "distinct") / words,
        "capitals": F.col(p + "capitals") / chars,
        "marks": F.col(p + "marks") / words,
        "line_words": F.log1p(F.col("n_words") / count),
        "digits": F.col(p + "digits") / chars,
    }
    found = F.struct(*COUNTS, *[features[k].cast("double").alias(f"f_{k}") for k in FEATURES])
    # a one-element explode: no filter on the statistics moves below it, where it would inline every array above
    new = {*COUNTS, *(f"f_{x}" for x in FEATURES)}
    kept = [c for c in docs.columns if c.lower() not in new]
    out = out.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(found)).alias(p))
    return out.select(*[F.col(f"`{c}`") for c in kept], f"{p}.*")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column | None = None) -> DataFrame:
    """(doc_id, text, _label) of every labelled id, with ``label`` as 0 or 1; of an id's texts the one of smallest hash.

    Null ids and null labels are no labels; an id labelled more than once takes the majority, 1 on a tie.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    if learn is not None:
        known = known.where(learn)
    found = docs.select("doc_id", "text").join(known, "doc_id")
    return found.groupBy("doc_id", "_label").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, learn: Column | None = None) -> DataFrame:
    """(doc_id, text, _label, _order) of at most ``rows`` labelled ids, with ``label`` as 0 or 1.

    The ids of smallest hash are taken, and of an id's texts the one of smallest hash, so there is one row for each id
    and the bound holds whatever repeats. It is what makes the broadcast safe. Null ids and null labels are no labels;
    an id labelled more than once takes the majority, 1 on a tie. Sort by _order for an order that doesn't vary.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    known = known.groupBy("doc_id").agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("_label"))
    if learn is not None:
        known = known.where(learn)
    known = known.withColumn("_order", F.xxhash64("doc_id")).orderBy("_order", "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")
    return found.groupBy("doc_id", "_label", "_order").agg(F.min_by("text", F.xxhash64("text")).alias("text"))


def collected(sample: DataFrame) -> np.ndarray:
    """A labelled sample's rows in order: the label, then the FEATURES."""
    rows = sample.select("_order", "doc_id", "_label", *[f"f_{f}" for f in FEATURES]).collect()
    return np.array([list(r)[2:] for r in sorted(rows, key=lambda r: (r["_order"], r["doc_id"]))], float).reshape(len(rows), len(FEATURES) + 1)
