"""The text operators against brute force on sf0.001, and on tables of odd rows."""

import hashlib
import inspect
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from viewflow.llm import queries as Q
from viewflow.llm.components import connected_components
from viewflow.llm.decontamination import Filter, align, contaminated, without_contaminated
from viewflow.llm.license_scan import NOTICES, PHRASES, license_scan
from viewflow.llm.lm_scoring import fit_model, score_documents
from viewflow.llm.packing import Ranges, hilbert_key, pack_sequences
from viewflow.llm import quality_classifier as quality_module
from viewflow.llm.quality_classifier import fit_classifier, quality_classifier
from viewflow.llm.quality_rules import Condition, fit_quality_rules, learn_rules, quality_rules
from viewflow.llm.simhash_dedup import block_masks, close_pairs, fingerprint, links, near_duplicates, simhash_components, without_near_duplicates
from viewflow.llm.substring_dedup import COVER, PERIOD, substring_dedup
from viewflow.llm.text_stats import COUNTS, FEATURES, labelled_sample, with_statistics
from viewflow.llm.token_counts import document_token_counts, token_counts
from viewflow.llm.token_files import EliasFano, document_digests, documents_at, read_token_files, token_folder, write_token_files
from viewflow.llm.tokens import coder
from viewflow.llm.wordarrays import Words, inside_rows, text_buffers, window_hashes

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k}" for k in range(45))
#: Nulls, empty and blank texts, repeated ids and rows, odd characters, and a passage that repeats.
ODD = [
    (1, LONG), (2, LONG), (2, LONG), (3, None), (4, ""), (5, " \n\t "), (None, "one two three"), (None, None), (6, "x " + LONG + " y"), (7, "a\x1cb 　c é <|endoftext|> '\x00."),
    (8, "CC-BY cc by General Public License all rights reserved"), (9, "same " * 400), (10, "\U0001f600 é ß"),
]
CLASHING = ("kept", "score", "shard", "part", "n_words", "block", "rest", "row", "f_words", "_vf_text", "fingerprint", "id", "tie", "place", "words", "label")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string").repartition(3)
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


@pytest.fixture(scope="module")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def statistics(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    count, covered = Counter(windows), [0] * len(words)
    for k, w in enumerate(windows):
        if count[w] > 1:
            covered[k : k + 8] = [1] * 8
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), sum(covered)


# 1


def test_statistics(docs, texts, odd, none):
    for r in with_statistics(docs).collect():
        assert tuple(r[c] for c in COUNTS) == statistics(texts[r.doc_id])
    got = Counter((r.text, *[r[c] for c in COUNTS]) for r in with_statistics(odd).collect())
    assert got == Counter((t, *statistics(t)) for _, t in ODD)
    assert with_statistics(none).count() == 0


def test_quality_rules(spark, labels, odd, none):
    got = Q.op1_quality_rules(spark, SF).join(labels, "doc_id").collect()
    assert all(r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words) for r in got)
    long = [r for r in got if not r.base_failed]
    assert np.mean([r.kept for r in long if r.quality == 1]) > 0.95
    no_labels = labels.where("false")
    out = quality_rules(odd, no_labels)
    assert out.count() == len(ODD) and {r.kept for r in out.where("doc_id < 3").collect()} == {True}
    assert {r.kept for r in out.where("text is null or doc_id in (4, 5, 9)").collect()} == {False}
    assert quality_rules(none, no_labels).count() == 0


def features(text):
    text = text or ""
    words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
    n, chars, count = max(1, len(words)), max(1, sum(map(len, words))), max(1, len(lines))
    _, c, symbols, dup, repeats = statistics(text)
    among = lambda allowed: sum(x in allowed for x in text)
    return {
        "words": np.log1p(len(words)), "word_length": c / n, "symbols": symbols / chars, "dup_lines": dup / count, "repeats": repeats / n, "distinct": len(set(words)) / n,
        "capitals": among(string.ascii_uppercase) / chars, "marks": among("!?.,;:") / n, "line_words": np.log1p(len(words) / count), "digits": among(string.digits) / chars,
    }


def test_verdicts_and_scores_by_hand(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    held = {r.doc_id: r for r in with_statistics(docs).collect()}
    for d, r in held.items():
        assert {f: r[f"f_{f}"] for f in FEATURES} == pytest.approx(features(texts[d]), rel=1e-12, abs=1e-12)
    rules, ranking = fit_quality_rules(docs, labels), fit_classifier(docs, labels)
    assert rules and ranking.steps
    numbers = {f: np.array([held[d][f"f_{f}"] for d in texts]) for f in FEATURES}
    first = [None] * len(texts)
    for k, rule in enumerate(rules):
        covered = np.logical_and.reduce([c.holds(numbers) for c in rule])
        first = [k if old is None and new else old for old, new in zip(first, covered, strict=True)]
    got = {r.doc_id: r for r in quality_rules(docs, labels).collect()}
    for d, rule in zip(texts, first, strict=True):
        n, _, _, _, repeats = statistics(texts[d])
        assert got[d].rule == rule and got[d].kept == (n >= 20 and 100 * repeats <= 30 * n and rule is None)
    strength = sum(np.where(numbers[f] >= bound, gain, 0.0) for f, bound, gain in ranking.steps)
    want = 1 / (1 + np.exp(-(strength - ranking.threshold + np.log(0.7 / 0.3))))
    scores = {r.doc_id: r.score for r in quality_classifier(docs, labels).collect()}
    assert [scores[d] for d in texts] == pytest.approx(want.tolist(), rel=1e-9)


def test_sample_is_bounded_whatever_repeats(spark):
    rows = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(k, "x") for k in range(2, 60)] + [(None, "y")], "doc_id long, text string")
    known = spark.createDataFrame([(k, k % 2) for k in range(60)] * 3 + [(None, 1), (5, None)], "doc_id long, quality int")
    for n in (5, 20, 1000):
        got = labelled_sample(rows, known, "quality", n).collect()
        assert len(got) <= n and len({r.doc_id for r in got}) == len(got) and all(r["_label"] == r.doc_id % 2 for r in got)


def test_learned_list():
    rng = np.random.default_rng(0)
    x, y = rng.random(3000), rng.random(3000)
    bad = ((x > 0.8) & (y < 0.5)) | (y > 0.95)
    rules = learn_rules({"x": x, "y": y}, bad)
    got = np.zeros(3000, bool)
    for rule in rules:
        covered = np.ones(3000, bool)
        for c in rule:
            covered &= c.holds({"x": x, "y": y})
        got |= covered
    assert (got == bad).mean() > 0.97
    assert learn_rules({"x": x}, np.zeros(3000, bool)) == [] and str(Condition("x", True, 0.5)) == "x >= 0.5"


# 2


def plain_alignment(a, b):
    h, best = np.zeros((len(a) + 1, len(b) + 1), int), 0
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
            best = max(best, h[i + 1, j + 1])
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(1, 4), min_size=1, max_size=9), st.lists(st.integers(1, 4), min_size=1, max_size=12)), min_size=1, max_size=5))
def test_alignment(pairs):
    score, _ = align([np.array(a, np.uint64) for a, _ in pairs], [np.array(b, np.uint64) for _, b in pairs])
    assert score.tolist() == [plain_alignment(a, b) for a, b in pairs]


def test_contaminated(spark, docs, texts, odd, none):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r for r in Q.op2_decontamination(spark, SF).collect()}
    known = [(r.item_id, r.text) for r in items.collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").lower())
    code = {}
    number = lambda t: np.array([code.setdefault(w, len(code) + 1) for w in split(t)], np.uint64)
    numbered = {i: number(t) for i, t in known}
    for d, text in texts.items():  # every pair, whether or not it shares a seed
        own = number(text)
        score, _ = align([numbered[i] for i, _ in known], [own] * len(known)) if len(own) else (np.zeros(len(known)), None)
        for (i, item), best in zip(known, score.tolist(), strict=True):
            share = best / (2 * len(numbered[i]))
            assert ((d, i) in got) == (share >= 0.5), (d, i, share)
            if share >= 0.5:
                assert got[d, i].score == pytest.approx(share)
    for (d, i), r in got.items():
        own = split(texts[d])[r.start_word : r.end_word]
        assert plain_alignment(split(dict(known)[i]), own) / (2 * len(split(dict(known)[i]))) == pytest.approx(r.score)
    words = LONG.split()
    edited = " ".join(["start", *words[:10], "new", *words[12:30], *words[31:], "end"]).upper()
    rows = spark.createDataFrame([(1, edited), (2, "w1 w2 w3 w4 and nothing else"), (3, None)], "doc_id long, text string")
    tests = spark.createDataFrame([(1, LONG), (2, None), (3, ""), (4, "two words")], "item_id long, text string")
    (found,) = contaminated(rows, tests).collect()
    assert found.doc_id == 1 and found.start_word == 1 and found.end_word == 44 and found.score > 0.85
    assert {(r.doc_id, r.text) for r in without_contaminated(odd, tests).collect()} == {(d, t) for d, t in ODD if t not in (LONG, "x " + LONG + " y")}
    clean = without_contaminated(odd, tests)
    assert clean.columns == odd.columns and clean.where("label <> 'clash'").count() == 0 and without_contaminated(none, tests).count() == 0
    assert contaminated(spark.createDataFrame([(1, "the cat and the dog")], "doc_id long, text string"), spark.createDataFrame([(1, "the"), (2, "the dog")], "item_id long, text string")).count() == 0
    assert {r.doc_id for r in contaminated(odd, tests).collect()} == {1, 2, 6}
    assert contaminated(none, tests).count() == 0 and contaminated(odd, tests.where("false")).count() == 0


def test_edited_copies_in_many_texts(spark):
    item = " ".join(f"q{k}" for k in range(60))
    edited = " ".join(f"e{k}" if k % 6 == 5 else f"q{k}" for k in range(60))
    rows = spark.createDataFrame([(d, f"a{d} b{d} {edited} c{d}") for d in range(1000)] + [(5000, "q0 q1 q2 q3 alone")], "doc_id long, text string")
    got = contaminated(rows, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(1000)) and {r.score for r in got} == {91 / 120}


def test_recall_of_edited_items(spark):
    rng, rows, want = np.random.default_rng(2), [], {}
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").collect()]
    for k, (i, text) in enumerate(items * 3):
        words, share = text.split(), (0.1, 0.2, 0.25)[k // len(items)]
        for at in rng.choice(len(words), int(share * len(words)), replace=False):
            words[at] = f"new{rng.integers(10**6)}"
        rows.append((k, " ".join(["before"] * 30 + words + ["after"] * 30)))
        want[k] = i
    every = [" ".join(f"new{k}" if k % 4 == 3 else w for k, w in enumerate(t.split())) for _, t in items]
    rows += [(1000 + k, t) for k, t in enumerate(every)]
    want |= {1000 + k: i for k, (i, _) in enumerate(items)}
    got = {(r.doc_id, r.item_id) for r in contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for low, high, least in ((0, len(items), 0.99), (len(items), 2 * len(items), 0.97), (2 * len(items), 3 * len(items), 0.9), (1000, 2000, 0.95)):
        own = [(d, want[d]) in got for d, _ in rows if low <= d < high]
        assert np.mean(own) >= least, (low, np.mean(own))


def test_filter_lets_every_seed_pass(spark):
    values = np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 5000)
    told = Filter.of(spark.createDataFrame([(int(v),) for v in values], "seed long"))
    some = np.concatenate((values, np.arange(1000))).view(np.uint64)
    assert told.hits(some).tolist() == list(range(5000))
    assert set(range(5000)) <= set(Filter(told.bits, None).hits(some).tolist())


# 3


def plain_log_probability(model, counts, words, k):
    """log p of the k-th of some words' hashes, from the definition; ``counts`` by hash."""
    net, own = model.network.net, model.network
    numbers = own.numbers(words)
    around = [numbers[k + s] if 0 <= k + s < len(words) else own.edge for s in (-2, -1, 1, 2)]
    h = np.tanh(np.concatenate([net["embed"][a] for a in around]) @ net["hidden"] + net["hidden_bias"])
    p = np.exp(h @ net["out"] + net["out_bias"])
    p /= p.sum()
    if numbers[k] >= own.known:
        return np.log(p[-1]) + np.log((counts.get(int(words[k].astype(np.int64)), 0) + 1) / (model.other_occurrences + model.other_words + 1))
    c, slot = divmod(int(numbers[k]), own.per_class)
    q = np.exp(h @ net["inner"][c] + net["inner_bias"][c])
    return np.log(p[c]) + np.log(q[slot] / q.sum())


SMALL = {"classes": 6, "per_class": 8, "masked": 3}


def test_scores(spark, docs, odd, none):
    model = fit_model(docs, **SMALL)
    counts = {r.word: r.n for r in model.counts.collect()}
    got = {r.doc_id: r for r in score_documents(docs, model).collect()}
    for r in docs.limit(3).collect():
        w = Words(*text_buffers(pa.array([r.text])), lower=True).hashes()
        want = sum(plain_log_probability(model, counts, w, k) for k in range(len(w)))
        assert got[r.doc_id].n_tokens == len(w) and got[r.doc_id].log_likelihood == pytest.approx(want, rel=1e-4)
    out = score_documents(odd, model).collect()
    assert len(out) == len(ODD) and all((r.score is None) == (r.n_tokens == 0) for r in out)
    empty = fit_model(none)
    assert score_documents(none, empty).count() == 0 and score_documents(odd, empty).count() == len(ODD)


def test_probabilities_sum_to_one(spark, docs):
    model = fit_model(docs, **SMALL)
    counts = {r.word: r.n for r in model.counts.collect()}
    words = np.array(sorted(counts), np.int64).view(np.uint64)
    rng = np.random.default_rng(3)
    for _ in range(3):
        window = rng.choice(words, 5)
        total = 0.0
        for w in [*words.tolist(), 12345]:  # every word of the corpus, and one that it doesn't have
            window[2] = w
            total += np.exp(plain_log_probability(model, counts, window, 2))
        assert total == pytest.approx(1, rel=1e-4)


def test_model_beats_single_words_and_ignores_partitions(spark):
    rng, rows = np.random.default_rng(5), []
    for d in range(400):  # each word tells its neighbours
        start = rng.integers(0, 60, 40)
        rows.append((d, " ".join(f"a{s} b{(7 * s + 3) % 60} c{(s * s) % 60}" for s in start)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    fit, held = df.where("doc_id < 300"), df.where("doc_id >= 300")
    settings = {"classes": 16, "per_class": 16, "masked": 2, "rounds": 2, "rate": 0.3}
    total = lambda m: sum(r.log_likelihood for r in score_documents(held, m).collect())
    plain, model = fit_model(fit, **settings | {"rounds": 0}), fit_model(fit.repartition(3), **settings)
    assert total(model) > total(plain) + 0.2 * abs(total(plain))
    for shard in (4000, 1000):
        a, b = (fit_model(fit.repartition(n), **settings, shard_windows=shard).network.net for n in (2, 7))
        assert all(np.array_equal(a[k], b[k]) for k in a)


# 4, 5 and 8


@pytest.fixture(scope="module")
def tokenizers():
    made = {}
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        made[name] = Tokenizer.from_file(public_tokenizers.path(name))
    return made


@pytest.fixture(scope="module")
def plain_text_tokenizer():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return t


def test_coder_is_the_tokenizer(tokenizers):
    strange = [t for _, t in ODD] + ["can't. 'S, x'll!\n\n  z", "x,̸ y", "Σας ΣΑΣ. b  c", "ab́ ́ c", "\r\n\t a\x0bb", "İx ŉ ª1²", "a <|endoftext|> b", "<|endoftext|><|startoftext|>x", "<|ENDOFTEXT|>", "<|endoftext", "|>"]
    for name, t in tokenizers.items():
        for i, _, ids, counts in coder(name).encode_rows(pa.array(strange, pa.string()), end=1):
            for text, got in zip(strange[i:], np.split(ids, np.cumsum(counts)[:-1]), strict=False):
                assert got.tolist() == [*t.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(st.characters(codec="utf-8") | st.sampled_from(" \n'.,a"), max_size=30), max_size=4))
def test_coder_on_any_text(strange):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        c = coder(name)
        got = [x for _, _, ids, counts in c.encode_rows(pa.array(strange, pa.string())) for x in np.split(ids, np.cumsum(counts)[:-1])]
        assert [x.tolist() for x in got] == [c.tokenizer.encode(t, add_special_tokens=False).ids for t in strange]


def test_token_counts(spark, texts, odd, none, plain_text_tokenizer):
    t = plain_text_tokenizer
    want = {d: len(t.encode(x or "", add_special_tokens=False).ids) for d, x in texts.items()}
    assert {r.doc_id: r.n_tokens for r in Q.op4_token_counts(spark, SF).collect()} == want
    got = document_token_counts(odd, token_folder(odd), "word_bpe_49k.json", 49407).collect()
    assert Counter(map(tuple, got)) == Counter((d, len(t.encode(x or "", add_special_tokens=False).ids)) for d, x in ODD)
    assert document_token_counts(none, token_folder(none), "word_bpe_49k.json", 49407).count() == 0


def test_scan_stitches_blocks(spark, tmp_path):
    ids = np.array([5, 9, 9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 1], "<u2")
    ids.tofile(tmp_path / "a")
    np.array([9], "<u2").tofile(tmp_path / "b")
    files = spark.createDataFrame([(str(tmp_path / "a"), len(ids), 2), (str(tmp_path / "b"), 1, 2), (str(tmp_path / "c"), 0, 2)], "file string, ids long, width long")
    for block in (1, 2, 3, 5, 100):
        got = sorted((r.file[-1], r.ordinal, r.n_tokens, r.closed) for r in token_counts(files, 9, block_ids=block).collect())
        assert got == [("a", 0, 1, True), ("a", 1, 0, True), ("a", 2, 8, True), ("a", 3, 1, False), ("b", 0, 0, True)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=600))
def test_elias_fano(values):
    values = np.sort(np.array(values, np.int64))
    made, rest = EliasFano.from_bytes(EliasFano.of(values).to_bytes() + b"rest")
    assert rest == b"rest" and [made.select(i) for i in range(len(values))] == values.tolist()
    for i in (0, len(values) // 3, len(values)):
        for j in (i, (i + len(values)) // 2, len(values)):
            assert made.slice(i, j).tolist() == values[i:j].tolist()
    with pytest.raises(IndexError):
        made.select(len(values))


def test_token_files(spark, texts, odd, none, tokenizers):
    t, at = tokenizers["word_bpe_49k.json"], 0
    got = {r.doc_id: r for r in Q.op5_token_files(spark, SF).collect()}
    for d in sorted(texts):
        ids = np.array([*t.encode(texts[d] or "", add_special_tokens=False).ids, 2], "<u4")
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    manifest = write_token_files(odd, token_folder(odd), "word_bpe_49k.json", 2).persist()
    rows = sorted(read_token_files(manifest, block_ids=3).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((d for d, _ in ODD), key=lambda d: (d is not None, d))
    assert [r.start for r in rows] == np.cumsum([0, *[r.n_tokens for r in rows]])[:-1].tolist()
    assert Counter((r.doc_id, r.ids) for r in rows) == Counter((d, np.array([*t.encode(x or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for d, x in ODD)
    wanted = spark.createDataFrame([(k,) for k in [*range(len(ODD)), 3, -1, len(ODD), None]], "place long")
    assert Counter(tuple(r)[1:] for r in documents_at(manifest, wanted).collect()) == Counter([*map(tuple, rows), tuple(rows[3])])
    assert document_digests(write_token_files(none, token_folder(none), "word_bpe_49k.json", 2)).count() == 0


def check_packing(rows, ids_of, length=2048):
    by, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for d, want in ids_of.items():
        pieces = sorted(by[d], key=lambda r: r.start)
        assert [r.start for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(want, "<u4").tobytes() and {r.doc_tokens for r in pieces} == {len(want)}
    for pieces in sequences.values():
        pieces.sort(key=lambda r: r.offset)
        total = sum(r.length for r in pieces)
        assert [r.offset for r in pieces] == np.cumsum([0, *[r.length for r in pieces]])[:-1].tolist()
        assert total == length or total & (total - 1) == 0


def test_packing(spark, docs, texts, odd, none, tokenizers):
    t = tokenizers["byte_bpe_50k.json"]
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts.items()}
    check_packing(pack_sequences(docs, "byte_bpe_50k.json", 1).collect(), ids)
    assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) for r in Q.op8_packing(spark, SF).collect())
    got = pack_sequences(odd, "byte_bpe_50k.json", 1, length=16).collect()
    assert Counter(r.doc_id for r in got if r.start == 0) == Counter(d for d, _ in ODD)
    assert sum(r.length for r in got) == sum(len(t.encode(x or "", add_special_tokens=False).ids) + 1 for _, x in ODD)
    assert pack_sequences(none, "byte_bpe_50k.json", 1).count() == 0


def test_equal_rows_are_spread(spark):
    text = "the same words again " * 200
    df = spark.createDataFrame([(None, text)] * 400 + [(k, f"other {k}") for k in range(100)], "doc_id long, text string").repartition(4)
    pieces = pack_sequences(df, "byte_bpe_50k.json", 1)
    rows = pieces.collect()
    parts = Counter(r.sequence_id >> 40 for r in rows if r.start == 0 and r.doc_id is None)
    assert sum(parts.values()) == 400 and len(parts) == 4 and max(parts.values()) < 200
    ranges, again = Ranges([5, 5, 5, 9]), Ranges([5, 5, 5, 9])
    places, ties = np.array([5, 5, 5, 4, 9, 10, 5]), np.array([7, 7, 8, 1, 2, 3, 7])
    order = np.array([6, 2, 0, 1, 5, 4, 3])
    first = Counter(zip(ties.tolist(), ranges.of(places, ties).tolist(), strict=True))
    assert first == Counter(zip(ties[order].tolist(), again.of(places[order], ties[order]).tolist(), strict=True))
    assert set(Ranges([5, 5, 5, 9]).of(np.full(50, 5), np.arange(50)).tolist()) == {0, 1, 2, 3}


def test_hilbert_neighbours_are_neighbours():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    keys = hilbert_key(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 6


def test_classifier(spark, labels, odd, none):
    got = Q.op6_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    assert np.mean([r.predicted == r.quality for r in held]) > 0.95
    out = quality_classifier(odd, labels.where("false"))
    assert out.count() == len(ODD) and out.where("held_out is null or score is null").count() == 0
    only = spark.createDataFrame([(1, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert {r.predicted for r in quality_classifier(odd, only).collect()} == {1}
    assert quality_classifier(none, labels).count() == 0


# 7


def removed_words(rows, window):
    seen, out = set(), []
    for d, text in rows:
        words, gone = WORD.findall(text or ""), set()
        for k in range(len(words) - window + 1):
            w = tuple(words[k : k + window])
            if w in seen:
                gone |= set(range(k, k + window))
            seen.add(w)
        out.append((d, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return out


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup(spark, texts, odd, none):
    want = removed_words(sorted(texts.items()), 20)
    got = sorted(map(tuple, Q.op7_substring_dedup(spark, SF).collect()))
    assert got == [(d, n, m, hashlib.sha256(k.encode()).hexdigest()) for d, n, m, k in want]
    out = substring_dedup(odd)
    assert set(odd.columns) - {"n_words", "kept"} <= set(out.columns) and out.where("label = 'clash'").count() == len(ODD)
    ordered = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0))
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in out.collect()) == Counter(removed_words(ordered, 20))
    assert substring_dedup(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup(odd, window=5)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90).map(" ".join), max_size=6), st.integers(13, 16))
def test_substring_dedup_on_repetitive_texts(spark, texts, window):
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring_dedup(df, window=window, block_bytes=64).collect())
    assert got == removed_words(rows, window)


# 9


def notice_labels(text, base, slack=3, share=0.7):
    """(labels, score) by looking, for every diagonal that a notice's 3-gram lies on, for the others near it."""
    words, found, best = ALNUM.findall(lower(text)), set(filter(None, base.split(","))), float(bool(base))
    for t in NOTICES:
        own = t.words.split()
        hits = {(i - s, s) for s in range(len(own) - 2) for i in range(len(words) - 2) if words[i : i + 3] == own[s : s + 3]}
        for centre in {d for d, _ in hits}:
            covered = len({s for d, s in hits if abs(d - centre) <= slack}) / (len(own) - 2)
            best = max(best, covered)
            found |= {t.label} if covered >= share else set()
    return ",".join(sorted(found)), best


PIECES = ["licensed under the", "apache license", "version 2 0", "licensed under the apache license version 2 0", "released under the mit license", "cc by", "x", "the mit"]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=12).map(" ".join), min_size=1, max_size=12))
def test_notices_on_repetitive_texts(spark, texts):
    rows = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.labels, r.score) == notice_labels(texts[r.doc_id], r.base_labels)


def test_repeated_openings_hide_no_notice(spark):
    notice = "licensed under the apache license version 2 0"
    texts = ["licensed under the " * 4 + notice, "licensed under the " * 6 + notice, "version 2 0 " * 6 + notice + " version 2 0" * 6]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [(r.labels, r.score) for r in got] == [("apache-2.0", 1.0)] * 3


def test_license_scan(spark, texts, odd, none):
    def want(text):
        words, places, found = ALNUM.findall(lower(text)), [], set()
        for t in PHRASES:
            own = t.words.split()
            at = [k for k in range(len(words) - len(own) + 1) if words[k : k + len(own)] == own]
            places += at
            found |= {t.label} if at else set()
        return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(found))

    for r in Q.op9_license_scan(spark, SF).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == want(texts[r.doc_id])
        assert (r.labels, r.score) == notice_labels(texts[r.doc_id], r.base_labels)
    got = Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in license_scan(odd).collect())
    assert got == Counter((d, *want(t)) for d, t in ODD)
    for r in license_scan(odd).collect():
        assert (r.labels, r.score) == notice_labels(dict(ODD)[r.doc_id], r.base_labels) or r.doc_id in (None, 2)
    notice = spark.createDataFrame([(1, "Released under the MIT license."), (2, "licensed under the apache software license version 2.0"), (3, "released the license"), (4, "K by cc Kby")], "doc_id long, text string")
    assert {r.doc_id: r.labels for r in license_scan(notice, share=0.5).collect()} == {1: "mit", 2: "apache-2.0", 3: "", 4: ""}
    assert license_scan(none).count() == 0


# 10


def brute_components(rows, shingle=3, bits=2):
    def print_of(text):
        words = WORD.findall(lower(text))
        hs = [xxhash.xxh64_intdigest(" ".join(words[k : k + shingle]).encode(), 42) for k in range(max(1, len(words) - shingle + 1))] if words else []
        return sum(1 << b for b in range(64) if hs and 2 * sum(h >> b & 1 for h in hs) > len(hs))

    prints = [(d, print_of(t)) for d, t in rows]
    groups = list(range(len(prints)))
    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits and groups[a] != groups[b]:
                old, new = groups[a], groups[b]
                groups = [new if g == old else g for g in groups]
    least = {g: min((d for (d, _), h in zip(prints, groups, strict=True) if h == g and d is not None), default=None) for g in groups}
    return Counter((d, f"{p:016x}", least[g]) for (d, p), g in zip(prints, groups, strict=True))


def test_simhash(spark, texts, odd, none):
    got = Counter(map(tuple, Q.op10_simhash_dedup(spark, SF).collect()))
    assert got == brute_components(sorted(texts.items()))
    assert Counter(map(tuple, simhash_components(odd).collect())) == brute_components(ODD)
    assert simhash_components(none).count() == 0
    assert fingerprint(b"") == 0 and fingerprint(b"A b") == fingerprint(b" a  b\n")


@pytest.mark.parametrize("bits", [1, 2])
def test_links_keep_components(spark, bits):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 4)
    values = {int(b) for b in base}
    for b in base:  # a crowd around each: everything within three flips of few bits
        for _ in range(120):
            v = int(b)
            for k in rng.integers(0, 14, 3):
                v ^= 1 << int(k)
            values.add(v)
    values = sorted(values)
    df = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    whole = list(range(len(values)))

    def find(x):
        while whole[x] != x:
            x = whole[x]
        return x

    for i, j in zip(*close_pairs(np.array(values, np.uint64), bits), strict=True):
        a, b = find(int(i)), find(int(j))
        whole[max(a, b)] = min(a, b)
    want = {v: values[find(k)] for k, v in enumerate(values)}
    for cap in (4, 10_000):
        roots = dict(map(tuple, connected_components(links(df, max_bits=bits, bucket_cap=cap)).collect()))
        assert {v: roots.get(v, v) for v in values} == want


def test_blocks_agree_for_close_pairs():
    rng, masks = np.random.default_rng(1), block_masks(2, 6)
    for _ in range(300):
        v = int(rng.integers(0, 1 << 62))
        w = v ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
        assert any(v & m == w & m for m in masks)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 160)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark, odd, none):
    rng = np.random.default_rng(4)
    rows = []
    for g in range(12):
        words = [f"t{x}" for x in rng.integers(0, 5000, 400)]
        for c in range(4):
            own = list(words)
            for k in rng.integers(0, 400, 2 * c):
                own[k] = f"n{rng.integers(0, 5000)}"
            rows.append((4 * g + c, " ".join(own)))
    got = dict(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == {d: d // 4 * 4 for d, _ in rows}
    out = near_duplicates(odd).collect()
    assert len(out) == len(ODD) and {r.component_id for r in out if r.doc_id in (1, 2)} == {1}
    assert near_duplicates(none).count() == 0 and without_near_duplicates(none).count() == 0
    kept = without_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.where("label <> 'clash'").count() == 0
    rows = Counter((r.doc_id, r.text) for r in kept.collect())
    words = lambda t: tuple((t or "").lower().encode().split())
    alike = {(1, LONG), (6, "x " + LONG + " y")}  # 41 of 43 windows of five words
    assert rows - Counter({(3, None): 1}) == Counter({(d, t): 1 for d, t in {x for x in ODD if words(x[1])} - {(2, LONG), (6, "x " + LONG + " y")}}), (rows, alike)
    assert rows[3, None] == 1 and len({words(t) for _, t in ODD}) - 1 == len(rows)


def test_rows_of_one_id_count_one_by_one(spark):
    text, other = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(7, text), (7, text), (7, other), (None, text), (None, "c " * 30), (None, "c " * 30)]
    kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter(map(tuple, kept)) == Counter([(7, text), (7, other), (None, "c " * 30)])


def near_components(rows, similarity=0.8):
    """{id: smallest id} by comparing all pairs of 5-word shingle sets."""
    sets = {}
    for d, t in rows:
        w = t.lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and group[a] != group[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= similarity:
                low, high = sorted((group[a], group[b]))
                group = {d: low if g == high else g for d, g in group.items()}
    return group


@pytest.mark.parametrize("crowd", [2, 10_000])
def test_crowded_deals_lose_no_pair(spark, crowd):
    rng, rows = np.random.default_rng(6), []
    base = [f"t{x}" for x in rng.integers(0, 5000, 300)]

    def edited(words, n, name):
        own = list(words)
        for k in rng.choice(len(own), n, replace=False):
            own[k] = f"{name}{rng.integers(0, 10**9)}"
        return own

    for c in range(60):  # 60 versions of one text, not alike themselves, and a second copy of each that is
        own = edited(base, 18, "n")
        rows += [(c, own), (100 + c, edited(own, 2, "m"))]
    rows = [(d, " ".join(w)) for d, w in rows]
    want = near_components(rows)
    assert all(want[100 + c] == want[c] for c in range(60)) and len(set(want.values())) > 30
    got = dict(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), crowd=crowd, table_bits=8).collect()))
    assert got == want


def test_near_duplicates_hold_to_the_similarity(spark):
    rng, rows = np.random.default_rng(7), []
    for g in range(120):  # pairs on both sides of 0.8
        words = [f"t{x}" for x in rng.integers(0, 50_000, 300)]
        own = list(words)
        for k in range(5, 5 + 10 * (4 + g % 5), 10):
            own[k] = f"n{g}"
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(own))]
    got = dict(map(tuple, near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    want = near_components(rows)
    alike = [d for d in want if want[d] != d]
    assert 40 < len(alike) < 80 and all(got[d] == d for d in want if want[d] == d)
    assert sum(got[d] == want[d] for d in alike) > 0.9 * len(alike)


def test_batches_split_deals():
    from viewflow.llm.simhash_dedup import _candidates

    rng = np.random.default_rng(8)
    deals = np.repeat(np.arange(12), [1, 3, 4, 5, 9, 1, 2, 30, 4, 1, 5, 7])
    nodes, values, roots = np.arange(len(deals)), rng.integers(0, 1 << 62, len(deals)), rng.integers(0, 3, len(deals))
    table = pa.RecordBatch.from_arrays([pa.array(x) for x in (deals, nodes, values, roots)], ["deal", "node", "f0", "root"])
    count = np.bincount(deals)
    want = {(int(i), int(j), None, None) for i in nodes for j in nodes if i < j and deals[i] == deals[j] and count[deals[i]] <= 4 and roots[i] != roots[j]}
    want |= {(int(i), None, int(deals[i]), int(roots[i])) for i in nodes if count[deals[i]] > 4}
    for step in (1, 2, 3, 5, 7, 100):
        got = [tuple(r.values()) for b in _candidates(iter([table.slice(k, step) for k in range(0, len(deals), step)]), 64, 4) for r in b.to_pylist()]
        assert len(got) == len(want) and set(got) == want


def test_a_large_group_costs_few_pairs(spark):
    rng, rows = np.random.default_rng(9), []
    base = [f"t{x}" for x in rng.integers(0, 5000, 300)]
    for d in range(300):
        own = list(base)
        for k in rng.choice(300, 3, replace=False):
            own[k] = f"n{d}"
        rows.append((d, " ".join(own)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    made = []
    from viewflow.llm import simhash_dedup

    write = simhash_dedup.write_table

    def counting(df, name, *by):
        out = write(df, name, *by)
        made.append((name, out[0].count()))
        return out

    simhash_dedup.write_table = counting
    try:
        got = dict(map(tuple, near_duplicates(df).collect()))
    finally:
        simhash_dedup.write_table = write
    assert set(got.values()) == {0}
    assert sum(n for name, n in made if name == "pairs") <= 8 * 300
    assert dict(map(tuple, near_duplicates(df, first_tables=0).collect())) == got


# words


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab \n\té　", max_size=25), max_size=5), st.integers(1, 4))
def test_word_arrays(texts, k):
    w = Words(*text_buffers(pa.array(texts, pa.string())))
    lists = [WORD.findall(t) for t in texts]
    assert np.diff(w.first).tolist() == [len(x) for x in lists]
    h = w.hashes()
    flat = [x for t in lists for x in t]
    assert (h[:, None] == h).tolist() == [[a == b for b in flat] for a in flat]
    good = inside_rows(w.first, k)
    windows = window_hashes(h, k)[good]
    want = [tuple(t[i : i + k]) for t in lists for i in range(len(t) - k + 1)]
    assert (windows[:, None] == windows).tolist() == [[a == b for b in want] for a in want]


def test_words_that_polynomials_confuse(spark):
    x = "a"
    for _ in range(10):  # each half is the other with its letters swapped
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    w = Words(*text_buffers(pa.array([f"{x} {y} {x}"])))
    h, (high, low) = w.hashes(), w.digests(np.arange(3))
    assert h[0] != h[1] and h[0] == h[2] and high[0] == high[2] != high[1] and low[0] == low[2] != low[1]
    rows = [(1, " ".join([f"w{k}" for k in range(19)] + [x])), (2, " ".join([f"w{k}" for k in range(19)] + [y]))]
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got) == [(d, 0, t) for d, t in rows]


def test_words_of_every_length():
    texts = ["x" * k + " " + "y" * k for k in range(1, 300)] + ["x" * k for k in range(1, 300)]
    w = Words(*text_buffers(pa.array(texts)))
    flat = [t for x in texts for t in x.split()]
    for got in (w.hashes(), *w.digests(np.arange(len(flat)))):
        assert len(set(got.tolist())) == len(set(flat)) == len(set(zip(flat, got.tolist(), strict=True)))


def test_ranking_learns_from_every_labelled_row(spark, monkeypatch):
    docs = spark.range(30_000).selectExpr("id as doc_id", "if(id % 2 = 0, 'good words here', 'BAD 1 2') as text")
    labels = spark.range(30_000).selectExpr("id as doc_id", "cast((id + 1) % 2 as int) as quality")
    seen, fit = [], quality_module.fit_ranking
    monkeypatch.setattr(quality_module, "fit_ranking", lambda table, **more: seen.append(table.count()) or fit(table, **more, rounds=3))
    ranking = fit_classifier(docs, labels)
    assert seen == [labels.where(~quality_module.held_out()).count()] and seen[0] > 20_000
    table = with_statistics(docs.limit(400)).selectExpr("*", "cast((doc_id + 1) % 2 as int) as _label")
    bounds = quality_module._bounds(table, 24)
    blocks = quality_module._blocks(table, bounds)
    sums = quality_module._sums(blocks, [np.arange(len(b) + 1) / 7 for b in bounds], 32, True).sum(axis=1)
    assert sums[:, 0].tolist() == pytest.approx([200, 200]) and sums[:, 1:].sum(axis=1).tolist() == pytest.approx([2000, 2000])
    got = {r.text: r.s for r in with_statistics(docs.limit(2)).withColumn("s", ranking.score()).collect()}
    assert got["good words here"] >= 0.7 > got["BAD 1 2"]


def test_network_sees_every_position(spark, monkeypatch):
    from viewflow.llm import lm_scoring
    from viewflow.llm.shared import map_arrow

    docs = spark.createDataFrame([(k, " ".join(f"w{(k * j) % 17}" for j in range(k))) for k in range(40)] + [(99, None)], "doc_id long, text string")
    rounds, settings = [], inspect.signature(fit_model).parameters
    monkeypatch.setattr(lm_scoring, "_round", lambda rows, network, shards, masked, turn, rate: rounds.append((rows, masked, turn)) or network)
    network = fit_model(docs, classes=6, per_class=8).network
    assert [x[1:] for x in rounds] == [(settings["masked"].default, k) for k in range(settings["masked"].default)]

    def count(batches, masked, turn):
        for _, _, _, words in lm_scoring._texts(batches):
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(lm_scoring._masked(words, network, masked, turn)[0])], pa.int64())})

    seen = [map_arrow(rows, lambda b, m=m, k=k: count(b, m, k), "n long").groupBy().sum().first()[0] for rows, m, k in rounds]
    assert sum(seen) == sum(range(40)) and min(seen) > 0


def plain_step(net, seen, windows, targets, rate, per_class):
    """A step from the definition: gradients of the mean of -log p, class by class, and rates that fall with their squares."""
    classes, n = len(net["inner"]), len(targets)
    softmax = lambda z: np.exp(z - z.max(axis=1, keepdims=True)) / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    x = net["embed"][windows].reshape(n, -1)
    h = np.tanh(x @ net["hidden"] + net["hidden_bias"])
    own = np.minimum(targets // per_class, classes)
    p = (softmax(h @ net["out"] + net["out_bias"]) - np.eye(classes + 1)[own]) / n
    change = {k: np.zeros(v.shape) for k, v in net.items()}
    change["out"], change["out_bias"], back = h.T @ p, p.sum(axis=0), p @ net["out"].T
    for c in set(own.tolist()) - {classes}:
        rows = np.flatnonzero(own == c)
        q = (softmax(h[rows] @ net["inner"][c] + net["inner_bias"][c]) - np.eye(per_class)[targets[rows] % per_class]) / n
        change["inner"][c], change["inner_bias"][c] = h[rows].T @ q, q.sum(axis=0)
        back[rows] += q @ net["inner"][c].T
    back *= 1 - h * h
    change["hidden"], change["hidden_bias"] = x.T @ back, back.sum(axis=0)
    np.add.at(change["embed"], windows.ravel(), (back @ net["hidden"].T).reshape(4 * n, -1))
    for k, v in change.items():
        seen[k] += v * v
        net[k] -= rate * v / (np.sqrt(seen[k]) + 1e-6)


@pytest.mark.parametrize("far", [0, 200])
def test_training_steps_are_those_of_the_definition(far):
    from viewflow.llm.lm_scoring import Descent, Network

    rng, classes, per_class, rest, dims, hidden = np.random.default_rng(4), 64, 64, 16, 12, 24
    shapes = {"embed": (classes * per_class + rest + 1, dims), "hidden": (4 * dims, hidden), "hidden_bias": (hidden,), "out": (hidden, classes + 1), "out_bias": (classes + 1,), "inner": (classes, hidden, per_class), "inner_bias": (classes, per_class)}
    net = {k: (rng.standard_normal(v) * 0.3).astype(np.float32) for k, v in shapes.items()}
    net["out_bias"] += far  # powers of e beyond the range of float
    net["inner_bias"] -= far
    net["inner_bias"][5, 9] = -1e4
    windows, targets = rng.integers(0, classes * per_class + rest + 1, (2500, 4)), np.minimum(rng.zipf(1.2, 2500) - 1, classes * per_class + rest - 1)
    own, plain, seen = Descent(Network(np.zeros(0, np.uint64), np.zeros(0, int), rest, net), 0.1), {k: v.astype(float) for k, v in net.items()}, {k: np.zeros(v.shape) for k, v in net.items()}
    own.steps(windows.astype(np.int32), targets.astype(np.int32), 1024)
    for a in range(0, 2500, 1024):
        plain_step(plain, seen, windows[a : a + 1024], targets[a : a + 1024], 0.1, per_class)
    for k, v in own.net().items():
        assert v.shape == shapes[k] and np.allclose(v, plain[k], rtol=1e-4, atol=2e-3), k
        assert np.mean(np.abs(v - plain[k])) < 1e-5 * max(1, np.abs(plain[k]).max()), k


def test_scores_do_not_depend_on_the_words_looked_up(spark, docs):
    models = [fit_model(docs, **SMALL, rounds=0, looked_up=n) for n in (0, 300, 1 << 18)]
    sizes = [len(m.common[0]) for m in models]
    assert sizes[0] == 0 and 0 < sizes[1] <= 300 < sizes[2] == models[2].other_words
    counts = {r.word: r.n for r in models[0].counts.collect()}
    assert all(counts[int(w)] == n for w, n in zip(models[1].common[0].view(np.int64), models[1].common[1], strict=True))
    a, *more = ({r.doc_id: r.log_likelihood for r in score_documents(docs, m).collect()} for m in models)
    assert all(b == pytest.approx(a, rel=1e-9) for b in more)
    unseen = score_documents(spark.createDataFrame([(1, "zzqx yyqx")], "doc_id long, text string"), models[2]).first()
    assert unseen.n_tokens == 2 and np.isfinite(unseen.log_likelihood)
