"""One text of some three megabytes beside short ones, through every operator."""

import random

import pytest

from viewflow.llm.decontamination import contaminated
from viewflow.llm.license_scan import license_scan
from viewflow.llm.lm_scoring import fit_model, score_documents
from viewflow.llm.packing import pack_sequences
from viewflow.llm.quality_classifier import quality_classifier
from viewflow.llm.quality_rules import quality_rules
from viewflow.llm.shared import write_table
from viewflow.llm.simhash_dedup import simhash_components, without_near_duplicates
from viewflow.llm.substring_dedup import substring_dedup
from viewflow.llm.token_counts import document_token_counts
from viewflow.llm.token_files import document_digests, token_folder, write_token_files
from viewflow.llm.tokens import coder

rng = random.Random(1)
WORDS = [f"w{rng.randrange(20_000)}" for _ in range(450_000)]
NOTICE, ITEM, SHORT = "released under the mit license", " ".join(WORDS[300_000:300_080]), "a short text of a few words"
LONG = " ".join([*WORDS, NOTICE])


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, SHORT), (3, " ".join(WORDS[200_000:200_400])), (4, LONG)]
    return write_table(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), "long")[0]


def by_id(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_native_operators(spark, docs):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = by_id(quality_rules(docs, labels), "n_words", "kept")
    assert got[1] == got[4] == (450_005, True) and got[2] == (7, False)
    assert by_id(quality_classifier(docs, labels), "predicted")[1] == (1,)
    found = by_id(license_scan(docs), "n_words", "labels", "score")
    assert found[1] == found[4] == (450_005, "mit", 1.0) and found[2] == (7, "", 0.0)


def test_passages_and_copies(spark, docs):
    got = by_id(substring_dedup(docs), "n_words", "n_removed")
    assert got == {1: (450_005, 0), 2: (7, 0), 3: (400, 400), 4: (450_005, 450_005)}
    item = spark.createDataFrame([(9, ITEM)], "item_id long, text string")
    assert by_id(contaminated(docs, item), "score", "start_word", "end_word") == {d: (1.0, 300_000, 300_080) for d in (1, 4)}
    assert by_id(simhash_components(docs), "component_id")[4] == (1,)
    assert sorted(by_id(without_near_duplicates(docs))) == [1, 2, 3]


def test_tokens_and_scores(spark, docs):
    import pyarrow as pa

    n = {d: int(sum(c.sum() for _, _, _, c in coder("word_bpe_49k.json").encode_rows(pa.array([t])))) for d, t in ((1, LONG), (2, SHORT))}
    counts = by_id(document_token_counts(docs, token_folder(docs), "word_bpe_49k.json", 49407), "n_tokens")
    assert counts[1] == counts[4] == (n[1],) and counts[2] == (n[2],)
    files = by_id(document_digests(write_token_files(docs, token_folder(docs), "word_bpe_49k.json", 2)), "start", "n_tokens")
    assert files[1] == (0, n[1] + 1) and files[2] == (n[1] + 1, n[2] + 1)
    pieces = pack_sequences(docs, "byte_bpe_50k.json", 1).drop("ids").collect()
    for d in (1, 4):
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == d)
        assert own[0][0] == 0 and all(a + b == c for (a, b, _), (c, _, _) in zip(own, own[1:], strict=False)) and sum(own[-1][:2]) == own[-1][2]
    scores = by_id(score_documents(docs, fit_model(docs)), "n_tokens", "log_likelihood")
    assert scores[1] == pytest.approx(scores[4]) and scores[1][0] == 450_005
