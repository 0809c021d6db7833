"""A training-corpus pipeline in five stages; each stage gets the rows that the one before it kept.

Rows count one by one, whatever their ids: no stage drops a row for what another row of its id holds. A null or empty
text fails the first stage; the others, given one, keep it (near-dedup keeps one of all texts without words). Null ids
are ids like others, though the last to stay in a group of near duplicates. An empty table gives no rows in any stage,
and columns other than those of ``documents`` are left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viewflow.llm.decontamination import without_contaminated
from viewflow.llm.packing import pack_sequences, piece_digests
from viewflow.llm.quality_rules import quality_rules
from viewflow.llm.shared import write_table
from viewflow.llm.simhash_dedup import without_near_duplicates
from viewflow.llm.substring_dedup import substring_dedup
from viewflow.session import make_importable

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or a learned rule rejects go, those without text among them."""
    labels = make_importable(spark).read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules(docs, labels).where("kept").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of smallest id stays; of equal ids, one."""
    return without_near_duplicates(docs.select(*COLUMNS), shingle_words=5, similarity=0.8)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages are cut out after their first place; texts without any, null ones too, stay as they are."""
    found = substring_dedup(docs.select(*COLUMNS), window=20)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text"))
    out = found.withColumn("text", text)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, or an edited copy of one, go."""
    items = make_importable(spark).read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_contaminated(docs.select(*COLUMNS), items)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids along the curve, a row for each piece; a null text is the end id alone."""
    return piece_digests(pack_sequences(docs, "byte_bpe_50k.json", 1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality),
    ("simhash near-dedup", near_dedup),
    ("substring dedup", passages),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Learned rules, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written to the shared folder and read by the next."""
    docs = make_importable(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, _ = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
