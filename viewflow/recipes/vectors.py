"""Weighted term vectors and joins by their similarity.

A text's terms are its occurrences, so a term that occurs twice counts twice in norms and products; occurrences of a
term in a text are counted first and carried as a factor, which leaves one row for each text and term to shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import operators as ops
from ..functions import fields, floor_div, safe_log, words
from ..session import stored


_COMMON = 200_000


@dataclass(frozen=True)
class _Corpus:
    """(doc, term, tf), all of a document's rows in one partition; (term, df), written; (ndoc), one row."""

    terms: DataFrame
    df: DataFrame
    ndoc: DataFrame


def _corpus(docs: DataFrame, doc: str, text: str, terms: Callable[[Column], Column], df: Column) -> _Corpus:
    """Whole texts are dealt out by document, so counting a document's terms, and all that is done for each document
    later, shuffles nothing. ``df`` is made of a term's rows. A document with a term has one more, null, by which
    documents are counted."""
    n = _partitions(docs)
    dealt = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text")).repartition(n, "doc").select("doc", terms(F.col("text")).alias("terms"))
    none = F.array(F.lit(None).cast("string"))
    marked = dealt.select("doc", F.explode(F.when(F.size("terms") > 0, F.concat("terms", none))).alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
    marked = marked.persist(StorageLevel.MEMORY_AND_DISK)  # stays where it is dealt to, while the session lasts
    counted = stored(marked.groupBy("term").agg(df.alias("df"), F.count("doc").alias("ndoc")), "frequencies")
    ndoc = counted.where("term is null").agg(F.coalesce(F.max("ndoc"), F.lit(0).cast("long")).alias("ndoc"))
    return _Corpus(marked.where("term is not null"), counted.where("term is not null").select("term", "df"), ndoc)


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_df(corpus: _Corpus, common: int) -> DataFrame:
    """(doc, term, tf, df), dealt by document: ``common`` terms at most, the most frequent, are looked up in a broadcast
    side view where the rows are; only rows of rarer terms are shuffled to meet their frequencies, and back."""
    least = corpus.df.select("df").orderBy(F.desc("df")).limit(common + 1).agg(F.min("df"), F.count("*")).first()
    if least[1] <= common:
        return corpus.terms.join(F.broadcast(corpus.df), "term").select("doc", "term", "tf", "df")
    frequent = F.broadcast(corpus.df.where(F.col("df") > least[0]))
    here = corpus.terms.join(frequent, "term").select("doc", "term", "tf", "df")
    rare = corpus.terms.join(frequent.select("term"), "term", "left_anti").join(corpus.df.where(F.col("df") <= least[0]), "term")
    return here.union(rare.select("doc", "term", "tf", "df").repartition(_partitions(rare), "doc"))


def _unit(weighted: DataFrame, *kept: str) -> DataFrame:
    """Weights divided by their document's norm, null where that is zero. A document's terms are one window's rows."""
    z = F.sum(F.col("tf") * F.col("w") * F.col("w")).over(Window.partitionBy("doc"))
    return weighted.select("doc", "term", "tf", (F.col("w") / F.nullif(F.sqrt(z), F.lit(0.0))).alias("weight"), *kept)


def _idf(ndoc: Column, df: Column, floor_idf: bool) -> Column:
    return safe_log((floor_div(ndoc, df) if floor_idf else ndoc / df).cast("double"))


def tfidf(docs: DataFrame, doc: str = "doc_id", text: str = "text", floor_idf: bool = False, common: int = _COMMON) -> DataFrame:
    """(doc, term, weight): unit vectors of ln(documents / documents with the term), by joins.

    ``floor_idf`` divides whole numbers, rounding down, so that terms of over half the documents weigh nothing.
    """
    corpus = _corpus(docs, doc, text, words, F.count("*"))
    weighted = ops.sideviews.augment_row(_with_df(corpus, common), corpus.ndoc).withColumn("w", _idf(F.col("side.ndoc"), F.col("df"), floor_idf))
    return _unit(weighted).select("doc", "term", "weight")


def tfidf_lookup(docs: DataFrame, doc: str = "doc_id", text: str = "text", floor_idf: bool = False, vocabulary: int = 1_000_000) -> DataFrame:
    """The same vectors with document frequencies looked up in a side view, broadcast, of the ``vocabulary`` most frequent
    terms; the others' are joined."""
    return tfidf(docs, doc, text, floor_idf, vocabulary)


def tfidf_lines(vectors: DataFrame) -> DataFrame:
    """(value): document, term and weight to three places, parted by tabs, for the vectors whose weight isn't null."""
    return vectors.where("weight is not null").select(F.format_string("%s\t%s\t%.3f", F.col("doc").cast("string"), "term", "weight").alias("value"))


def relation_vectors(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, weight, df) of one relation: ln 2 * ln(documents / occurrences of the term), unit length."""
    return _relation(docs, doc, text)[0]


def _relation(docs: DataFrame, doc: str, text: str) -> tuple[DataFrame, DataFrame]:
    """relation_vectors(), dealt by document, and (term, df)."""
    corpus = _corpus(docs, doc, text, lambda c: fields(F.lower(c), " "), F.sum("tf"))
    weighted = ops.sideviews.augment_row(_with_df(corpus, _COMMON), corpus.ndoc).withColumn("w", F.lit(math.log(2.0)) * F.ln(F.col("side.ndoc") / F.col("df")))
    return _unit(weighted, "df"), corpus.df


def _similar(left: DataFrame, right: DataFrame, least: float, small: bool = False) -> DataFrame:
    """Pairs over all common terms. A ``small`` left side is broadcast to where the right's documents are, and since all
    of a document's terms are there, its pairs are summed there too."""
    a = left.select(F.col("doc").alias("doc1"), "term", (F.col("tf") * F.col("weight")).alias("a"))
    b = right.select(F.col("doc").alias("doc2"), "term", (F.col("tf") * F.col("weight")).alias("b"))
    found = b.join(F.broadcast(a) if small else a, "term").groupBy("doc1", "doc2").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return found.where(F.col("sim") > least)


def _candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (doc1, doc2) that have a term of the left text's prefix in common: all that can exceed ``least`` are there.

    Of a left text's terms the most frequent on the right are left out as long as the length of what they make up,
    times the right texts' greatest length, stays at ``least`` or below, since no pair gets more from these alone.
    """
    share = F.col("tf") * F.col("weight")
    lengths = right.groupBy("doc").agg(F.sum(share * share).alias("z"))
    most = lengths.agg(F.sqrt(F.max("z")).alias("most"))
    known = left.join(right.select("term", "df").distinct().withColumnRenamed("df", "right_df"), "term")
    frequent = Window.partitionBy("doc").orderBy(F.desc("right_df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    met = ops.sideviews.augment_row(known.withColumn("left_out", F.sum(share * share).over(frequent)), most)
    prefix = met.where(F.sqrt("left_out") * F.col("side.most") * (1 + 1e-9) > least)
    pairs = prefix.select(F.col("doc").alias("doc1"), "term").join(right.select(F.col("doc").alias("doc2"), "term"), "term")
    return pairs.select("doc1", "doc2").distinct()


def soft_join(left: DataFrame, right: DataFrame, left_doc: str, right_doc: str, text: str = "text", least: float = 0.75) -> DataFrame:
    """(doc1, doc2, sim): pairs whose vectors' product exceeds ``least``, over all common terms.

    A left relation that fits a side view is broadcast, see _similar(). For larger ones a threshold above zero decides
    which terms have to be joined on at all, see _candidates(); pairs found so are then multiplied out over all of their
    terms.
    """
    a, (b, _) = stored(relation_vectors(left, left_doc, text), "left"), _relation(right, right_doc, text)
    measured, small = ops.sideviews.measured(a)
    if small or least <= 0:
        return _similar(measured, b, least, small)
    b = stored(b, "right")
    pairs = _candidates(a, b, least)
    x = a.select(F.col("doc").alias("doc1"), "term", (F.col("tf") * F.col("weight")).alias("a"))
    y = b.select(F.col("doc").alias("doc2"), "term", (F.col("tf") * F.col("weight")).alias("b"))
    found = pairs.join(x, "doc1").join(y, ["doc2", "term"]).groupBy("doc1", "doc2").agg(F.sum(F.col("a") * F.col("b")).alias("sim"))
    return found.where(F.col("sim") > least)


def soft_join_pruned(left: DataFrame, right: DataFrame, left_doc: str, right_doc: str, text: str = "text", least: float = 0.65, top_terms: int = 3, least_weight: float = 0.2, most_df: int = 50) -> DataFrame:
    """The same over useful terms only: among a left text's heaviest, heavy enough in one, and not frequent.

    Similarities are sums over these terms, so they may be lower, and some pairs are left out: this is the
    approximate form, for relations with terms too frequent to join on.
    """
    vectors, known = _relation(left, left_doc, text)
    a, (b, right_known) = stored(vectors, "left"), _relation(right, right_doc, text)
    rank = F.row_number().over(Window.partitionBy("doc").orderBy(F.desc("weight"), F.desc("term")))
    top = a.withColumn("r", rank).where(F.col("r") <= top_terms).select("term")
    heavy = a.where(F.col("weight") >= least_weight).select("term")
    rare = known.union(right_known).where(F.col("df") <= most_df).select("term")
    useful = top.intersect(heavy).intersect(rare)
    kept, small = ops.sideviews.measured(a.join(useful, "term", "left_semi"))
    return _similar(kept, b, least, small)
