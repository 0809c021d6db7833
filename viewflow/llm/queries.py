"""The registered queries over the text tables: thin digests of what the operators return."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import make_importable


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return make_importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import columns, quality_rules

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules(docs, _table(spark, sf_dir, "labels")).select(*columns())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import contaminated

    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_scoring import fit_model, score_documents

    docs = _table(spark, sf_dir, "documents")
    return score_documents(docs, fit_model(docs))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import document_token_counts
    from .token_files import token_folder

    docs = _table(spark, sf_dir, "documents")
    return document_token_counts(docs, token_folder(docs), "word_bpe_49k.json", 49407)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_files import document_digests, token_folder, write_token_files

    docs = _table(spark, sf_dir, "documents")
    return document_digests(write_token_files(docs, token_folder(docs), "word_bpe_49k.json", 2))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_sequences, piece_digests

    return piece_digests(pack_sequences(_table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_classifier

    return quality_classifier(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), cut=0.7)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    found = substring_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=20)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(_table(spark, sf_dir, "documents"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash_dedup import simhash_components

    return simhash_components(_table(spark, sf_dir, "documents"), shingle_words=3, max_bits=2)


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_decontamination": op2_decontamination,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_token_counts": op4_token_counts,
    "op5_token_files": op5_token_files,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_license_scan": op9_license_scan,
    "op10_simhash_dedup": op10_simhash_dedup,
}
_SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents),
s AS (SELECT doc_id, i, array_to_string(l[i:i + 19], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, len(l) - 18)) AS i FROM d WHERE len(l) >= 20)),
f AS (SELECT doc_id, i FROM s QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
c AS (SELECT DISTINCT doc_id, i + k AS p FROM f, range(0, 20) r(k)),
w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS kept, count(*) AS n FROM w ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, len(l) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""


def _license_sql() -> str:
    """From the definition: phrases are compared with every place's words, and for every diagonal on which a notice's
    3-gram stands the notice's 3-grams standing within three words of it are counted."""
    from .license_scan import LOWER, NOTICES, PHRASES, UPPER

    phrases = ", ".join(f"('{t.label}', '{t.words}', {len(t.words.split())})" for t in PHRASES)
    notices = ", ".join(f"({number}, '{t.label}', '{t.words}')" for number, t in enumerate(NOTICES))
    return rf"""
WITH p(label, phrase, n) AS (VALUES {phrases}), s(notice, label, words) AS (VALUES {notices}),
t AS (SELECT notice, label, slot, array_to_string(string_split(words, ' ')[slot:slot + 2], ' ') AS gram, len(string_split(words, ' ')) - 2 AS grams FROM s, range(1, 40) r(slot) WHERE slot + 2 <= len(string_split(words, ' '))),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS l FROM documents),
w AS (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM d),
b AS (SELECT doc_id, label, i - 1 AS pos FROM w JOIN p ON array_to_string(l[i:i + n - 1], ' ') = phrase),
h AS (SELECT doc_id, notice, label, grams, slot, i - slot AS diagonal FROM (SELECT doc_id, i, array_to_string(l[i:i + 2], ' ') AS gram FROM w WHERE i + 2 <= len(l)) JOIN t USING (gram)),
c AS (SELECT x.doc_id, x.label, count(DISTINCT h.slot) / x.grams AS covered FROM (SELECT DISTINCT doc_id, notice, label, grams, diagonal FROM h) x
      JOIN h ON h.doc_id = x.doc_id AND h.notice = x.notice AND abs(h.diagonal - x.diagonal) <= 3 GROUP BY x.doc_id, x.notice, x.label, x.grams, x.diagonal),
a AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY doc_id),
e AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM b UNION SELECT doc_id, label FROM c WHERE covered >= 0.7) GROUP BY doc_id),
f AS (SELECT doc_id, max(covered) AS score FROM (SELECT doc_id, covered FROM c UNION ALL SELECT doc_id, 1 FROM b) GROUP BY doc_id)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN f USING (doc_id)"""


#: Learned rules and weights, BPE ids, alignments and XXH64 fingerprints are beyond SQL; tests hold those against brute force.
ORACLE_SQL: dict[str, str] = {"op7_substring_dedup": _SUBSTRING_SQL, "op9_license_scan": _license_sql()}
