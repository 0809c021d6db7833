"""The pipeline's stages, each on what the one before it kept."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from viewflow.llm.shared import write_table
from viewflow.llm.tokens import tokenizer_path

from tests.llm.test_llm import LONG, near_components, removed_words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """(rows before, rows after) of each stage but the last, and the last one's pieces."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after, _ = write_table(stage(spark, docs, SF), "stage")
        assert tuple(after.columns) == corpus_pipeline.COLUMNS and dict(after.dtypes) == dict(docs.dtypes), name
        out.append(({r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in after.collect()}))
        docs = after
    return out, corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()


def test_quality_keeps_good_documents(spark, stages):
    before, after = stages[0][0]
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(after[d] == before[d] for d in after)
    long = [d for d, q in quality.items() if q == 1 and len(before[d].text.split()) >= 20]
    assert sum(d in after for d in long) >= 0.95 * len(long)
    assert not any(len(r.text.split()) < 20 for r in after.values())


def test_near_dedup_leaves_one_of_each_group(stages):
    before, after = stages[0][1]
    # all links of 0.8 and more, and no others, make the groups, but for the few that fingerprints miss
    groups = near_components([(d, r.text) for d, r in before.items()])
    wrong = [d for d in before if (d in after) != (groups[d] == d)]
    assert len(wrong) <= 0.02 * len(before) and not [d for d in wrong if d not in after]

    def shingles(text):
        words = text.lower().split()
        return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}

    sets = {d: shingles(r.text) for d, r in before.items()}
    alike = lambda a, b: len(sets[a] & sets[b]) / max(1, len(sets[a] | sets[b]))
    kept = sorted(after)
    assert all(after[d] == before[d] for d in kept)
    assert not [(a, b) for a in kept for b in kept if a < b and alike(a, b) >= 0.85]
    assert all(any(d > k and alike(d, k) > 0.5 for k in before if k != d) for d in before.keys() - after.keys())


def test_passages_stand_once(stages):
    before, after = stages[0][2]
    for d, n, gone, kept in removed_words(sorted((d, r.text) for d, r in before.items()), 20):
        assert after[d].text == (kept if gone else before[d].text) and (after[d].n_chars == len(kept) if gone else after[d] == before[d])


def test_benchmark_items_are_gone(spark, stages):
    before, after = stages[0][3]
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {d for d, r in before.items() if any(i in r.text for i in items)}
    assert not holds & after.keys() and all(after[d] == before[d] for d in after)
    assert len(before) - len(after) <= len(holds) + 2


def test_packing_holds_every_id(stages):
    texts, t = stages[0][3][1], Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    assert sum(r.length for r in stages[1]) == sum(len(t.encode(r.text, add_special_tokens=False).ids) + 1 for r in texts.values())
    for r in stages[1]:
        ids = np.array([*t.encode(texts[r.doc_id].text, add_special_tokens=False).ids, 1], "<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())


def test_run_is_the_stages(spark, stages):
    key = lambda r: (r.doc_id, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, SF).collect())) == sorted(map(key, stages[1]))


def test_odd_rows_through_all_stages(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first().text
    unique = " ".join(f"u{k}" for k in range(60))
    rows = [
        (1, LONG), (1, unique), (2, LONG), (None, LONG), (None, f"before it {item} after it"), (None, " ".join(f"v{k}" for k in range(60))), (3, None), (4, ""), (5, " \n"),
        (6, f"{item} {unique[:30]}"), (6, " ".join(f"x{k}" for k in range(60))), (7, unique), (7, unique),
    ]
    df = spark.createDataFrame([(d, t, "en", "s", len(t or ""), "clash") for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long, row string").repartition(3)
    quality, near, passages, clean, packing = (stage for _, stage in corpus_pipeline.STAGES)
    of = lambda df: Counter((r.doc_id, r.text) for r in df.collect())
    assert of(quality(spark, df, SF)) == Counter((d, t) for d, t in rows if t and len(t.split()) >= 20)
    kept = of(near(spark, df, SF))
    no_words = Counter({(3, None): 1})
    assert kept == Counter({(1, LONG): 1, (1, unique): 1, (None, rows[4][1]): 1, (None, rows[5][1]): 1, rows[9]: 1, rows[10]: 1}) + no_words
    cut = of(passages(spark, df, SF))
    assert cut[1, LONG] + cut[None, LONG] == 1 and cut[3, None] == cut[4, ""] == 1 and sum(cut.values()) == len(rows)
    assert of(clean(spark, df, SF)) == Counter((d, t) for d, t in rows if item not in (t or ""))
    assert Counter(r.doc_id for r in packing(spark, df, SF).collect() if r.start == 0) == Counter(d for d, _ in rows)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, df.where("false"), SF).count() == 0
