"""Licence notices in running text, by diagonal voting, in Spark expressions alone.

All rolling word k-grams of every text are hashed and joined to the k-grams of the templates. A hit votes for the
diagonal (place in the text minus place in the template); votes are summed per text, template and diagonal. Around
each diagonal its neighbours up to ``slack`` away are merged, so that a few inserted or missing words don't split a
notice, and a span counts if enough of the template's places were hit, each by the very words. Hits elsewhere, however
many, neither help nor hinder a span. Short phrases have to be hit at every place, on one diagonal.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A notice's words. ``exact``: a phrase, every place of which counts; else a share of its k-grams is enough."""

    label: str
    words: str
    exact: bool = False


#: The phrases that the query's result is defined by.
PHRASES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
)
#: Sentences by which well-known licences announce themselves.
NOTICES = (
    Template("apache-2.0", "licensed under the apache license version 2 0"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by-nc", "licensed under cc by nc 4 0"),
    Template("cc-by-sa", "licensed under cc by sa 4 0"),
    Template("gpl-3.0", "licensed under the gnu general public license version 3"),
    Template("mit", "released under the mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _grams(spark: SparkSession, templates: tuple[Template, ...]) -> DataFrame:
    """The templates' k-grams: 3 words, or 2 for a template of two; and one row that every text's marker meets."""
    rows = [(0, "", "", "", -1, "", False, 0, 0)]
    for number, t in enumerate(templates):
        words = t.words.split()
        k = min(3, len(words))
        n = len(words) - k + 1
        if k < 2 or n > 60:
            raise ValueError("a template has 2 to 62 words")
        for at in range(n):
            gram = [*words[at : at + k], ""][:3]
            rows.append((k, *gram, number, t.label, t.exact, at, n))
    kind = "k int, t1 string, t2 string, t3 string, template int, label string, exact boolean, at int, grams int"
    made = spark.createDataFrame(rows, kind)
    return made.withColumn("h", _hash(F.col("k"), F.col("t1"), F.col("t2"), F.col("t3")))


def _hash(k: Column, *words: Column) -> Column:
    return F.when(k == 3, F.xxhash64(F.lit(3), *words)).when(k == 2, F.xxhash64(F.lit(2), *words[:2])).otherwise(F.lit(0).cast("long"))


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = PHRASES + NOTICES, *, slack: int = 3, share: float = 0.7, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts the places of exact templates and first_word and last_word are their smallest and largest start;
    base_labels are theirs and labels all, distinct, sorted and comma-joined. A notice is there if ``share`` of its
    k-grams stand within ``slack`` words of where one diagonal puts them; score is the largest such share of any notice,
    1 for a phrase. Null and empty texts have no words: zeros, null places, empty labels.
    Rows of equal or null id each get a row; an empty table gives none; columns besides id and text are not read.
    The templates are a parameter of at most some thousands of k-grams, which bounds what is broadcast.
    """
    grams = _grams(docs.sparkSession, templates)
    if sum(len(t.words) for t in templates) > 1 << 20:
        raise ValueError("templates of over a million characters are too many to broadcast")
    text = F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(id_column).alias("doc_id"), F.array_remove(F.split(text, SEPARATORS), "").alias("words"), F.monotonically_increasing_id().alias("row"))
    n = F.size("words")
    word = lambda i: F.get(F.col("words"), i)
    at = F.transform(F.sequence(F.lit(-1), n - 2), lambda i: F.struct(i.alias("i"), word(i).alias("w1"), word(i + 1).alias("w2"), word(i + 2).alias("w3")))
    at = F.when(n >= 2, at).otherwise(F.array(F.struct(F.lit(-1).alias("i"), *[F.lit(None).cast("string").alias(f"w{k}") for k in (1, 2, 3)])))
    # the number of words is a column before rows multiply, so that no row carries the text's words along
    each = rows.withColumn("n_words", n.cast("long")).select("row", "doc_id", "n_words", F.explode(at).alias("g"))
    each = each.select("row", "doc_id", "n_words", "g.*")
    low = [F.lower(f"w{k}") for k in (1, 2, 3)]
    three = F.when(F.col("w3").isNotNull() & (F.col("i") >= 0), F.xxhash64(F.lit(3), *low))
    two = F.when(F.col("i") >= 0, F.xxhash64(F.lit(2), *low[:2])).otherwise(F.lit(0).cast("long"))
    each = each.withColumn("h", F.explode(F.array(three, two)))
    own = lambda k: F.translate(F.col(f"w{k}"), UPPER, LOWER) == F.col(f"t{k}")
    exact = (F.col("k") == 0) | (own(1) & own(2) & ((F.col("k") == 2) | own(3)))
    hits = each.join(F.broadcast(grams), "h").where(exact)
    place = [F.col(c) for c in ("row", "doc_id", "n_words", "template", "label", "exact", "grams")]
    votes = hits.groupBy(*place, (F.col("i") - F.col("at")).alias("diagonal")).agg(F.expr("bit_or(shiftleft(1L, at))").alias("hit"))
    around = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(-slack, slack)
    merged = votes.withColumn("span", F.when(F.col("exact"), F.col("hit")).otherwise(F.expr("bit_or(hit)").over(around)))
    covered = F.bit_count("span") / F.greatest("grams", F.lit(1))
    is_text = F.col("template") >= 0
    base = is_text & F.col("exact") & (covered == 1)
    notice = is_text & ~F.col("exact")
    found = base | (notice & (covered >= share))
    labels = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return merged.groupBy("row", "doc_id", "n_words").agg(
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("diagonal"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("diagonal"))).cast("long").alias("last_word"),
        labels(base).alias("base_labels"),
        labels(found).alias("labels"),
        F.max(F.when(base | notice, covered).otherwise(0.0)).alias("score"),
    ).drop("row")
