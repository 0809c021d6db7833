"""Benchmark decontamination: n-gram seeds join texts to test items, Smith-Waterman alignment scores the passages.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased, so case and punctuation don't
matter. Seeds are the items' word n-grams. One pass over the texts finds where seeds stand, and Spark joins these
places to the items on the seed's hash. N-grams are rare enough as they are: every seed leads to a passage, however
many texts hold it, since an edited copy may have kept only frequent ones. Seeds around one place are one passage.
Passages without enough of their item's words to reach the threshold are left out, which loses nothing; the others are aligned
to their items with numpy: insertions, deletions and replaced words cost a little.

What the tasks of the first pass get is a filter of fixed size over the seeds' hashes, and the sorted hashes as well
up to EXACT of them; beyond that, some n-grams that are no seeds pass the filter and find nothing in the join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, write_table
from .wordarrays import PUNCTUATION, U, Words, inside_rows, row_numbers, slices, text_buffers, window_hashes

MATCH, MISMATCH, GAP = 2, -1, -1
FILTER_BITS, EXACT = 1 << 24, 1 << 22


def _words(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, spaces=PUNCTUATION)


def _lower(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return text_buffers(pc.utf8_lower(column))


def _binary(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """A binary for each row: its values, eight bytes each."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer((first - first[0]) * 8), pa.py_buffer(values[first[0] : first[-1]].tobytes())]).cast(pa.binary())


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman scores of item-passage pairs, and the passages' words up to the end of the best alignment.

    All pairs advance together, an item word at a time; the gap along the passage is a running maximum.
    """
    n, rows, cols = len(items), max(map(len, items)), max(map(len, passages))
    a, b = np.zeros((n, rows), U), np.zeros((n, cols), U)
    for k in range(n):
        a[k, : len(items[k])] = items[k]
        b[k, : len(passages[k])] = passages[k]
    seen_a, seen_b = a != 0, b != 0
    h = np.zeros((n, cols + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    slope = np.arange(cols + 1, dtype=np.int32) * -GAP
    for i in range(rows):
        same = np.where((a[:, i : i + 1] == b) & seen_a[:, i : i + 1] & seen_b, MATCH, MISMATCH)
        t = np.zeros_like(h)
        t[:, 1:] = np.maximum(0, np.maximum(h[:, :-1] + same, h[:, 1:] + GAP))
        h = np.maximum(t, np.maximum.accumulate(t + slope, axis=1) - slope)
        top = h.argmax(axis=1)
        value = h[np.arange(n), top]
        better = value > best
        best, end = np.where(better, value, best), np.where(better, top, end)
    return best, end


def item_seeds(items: DataFrame, n: int) -> DataFrame:
    """(item, item_id, words, seeds): each item's word hashes and, for every place, its n-gram's hash, as binaries.

    An item of fewer than ``n`` words has no seed.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = _words(*_lower(b.column("text")))
            hashes, first = words.hashes(), words.first
            seeds = [window_hashes(hashes[i:j], n).view(np.int64) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), _binary(hashes, first), pa.array(seeds, pa.list_(pa.int64()))], ["item_id", "words", "seeds"])

    known = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(known, read, "item_id long, words binary, seeds array<long>").withColumn("item", F.monotonically_increasing_id())


class Filter:
    """Tells n-grams that may be seeds: a table of hash bits, and where they are few enough the hashes themselves."""

    def __init__(self, bits: np.ndarray, exact: np.ndarray | None):
        self.bits, self.exact = bits, exact

    @classmethod
    def of(cls, seeds: DataFrame) -> Filter:
        """From a table's column ``seed``; at most FILTER_BITS / 64 numbers and EXACT hashes reach the driver."""
        slot = F.col("seed").bitwiseAND(FILTER_BITS - 1)
        words = seeds.groupBy(F.shiftright(slot, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(seed & 63 as int)))").alias("word")).toArrow()
        bits = np.zeros(FILTER_BITS // 64, U)
        bits[words.column("at").to_numpy()] = words.column("word").to_numpy().view(U)
        some = seeds.select("seed").distinct().limit(EXACT + 1).toArrow().column("seed").to_numpy().view(U)
        return cls(bits, np.sort(some) if len(some) <= EXACT else None)

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places of n-grams that may be seeds."""
        slot = hashes & U(FILTER_BITS - 1)
        at = np.flatnonzero((self.bits[(slot >> U(6)).astype(np.int64)] >> (slot & U(63))) & U(1))
        if self.exact is not None and len(at):
            near = np.minimum(np.searchsorted(self.exact, hashes[at]), len(self.exact) - 1)
            at = at[self.exact[near] == hashes[at]]
        return at


def _places(batches: Iterator[pa.RecordBatch], seeds: Filter, n: int) -> Iterator[pa.RecordBatch]:
    """Rows with a seed: their id, their words' hashes, and the seeds with their places."""
    for batch in batches:
        data, offsets = _lower(batch.column("text"))
        for i, j in slices(offsets):
            words = _words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            hashes = words.hashes()
            own = window_hashes(hashes, n)
            at = seeds.hits(own)
            at = at[inside_rows(words.first, n)[at]]
            if not len(at):
                continue
            row = row_numbers(words.first)[at]
            held, start = np.unique(row, return_index=True)
            cut = pa.array(np.append(start, len(at)).astype(np.int32))
            texts = pa.array([hashes[words.first[r] : words.first[r + 1]].tobytes() for r in held.tolist()], pa.binary())
            columns = [batch.column("doc_id").take(pa.array(held + i)), texts, pa.ListArray.from_arrays(cut, pa.array(own[at].view(np.int64))), pa.ListArray.from_arrays(cut, pa.array((at - words.first[row]).astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "seeds", "places"])


def _align_rows(batches: Iterator[pa.RecordBatch], threshold: float, cells: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """Rows (row, doc_id, item, item_id, low, own, passage): the alignments that reach the threshold."""
    for batch in batches:
        own = [np.frombuffer(x.as_buffer(), U) for x in batch.column("own")]
        text = [np.frombuffer(x.as_buffer(), U) for x in batch.column("passage")]
        # an alignment that reaches the threshold matches so many of the item's words
        able = [k for k in range(len(own)) if np.count_nonzero(np.isin(own[k], text[k])) >= threshold * len(own[k])]
        able.sort(key=lambda k: len(text[k]))
        out, at = [], 0
        while at < len(able):
            to = at + 1
            while to < len(able) and (to + 1 - at) * len(text[able[to]]) <= cells:
                to += 1
            part, at = able[at:to], to
            score, end = align([own[k] for k in part], [text[k] for k in part])
            share = score / np.array([MATCH * len(own[k]) for k in part])
            good = np.flatnonzero(share >= threshold)
            if len(good):
                _, back = align([own[part[g]][::-1] for g in good], [text[part[g]][: end[g]][::-1] for g in good])
                out += [(part[g], float(share[g]), int(end[g]) - int(length), int(end[g])) for g, length in zip(good.tolist(), back.tolist(), strict=True)]
        if out:
            kept = batch.take(pa.array([k for k, *_ in out]))
            low = kept.column("low").to_numpy()
            columns = [pa.array([x[1] for x in out]), pa.array(low + [x[2] for x in out]), pa.array(low + [x[3] for x in out])]
            yield pa.RecordBatch.from_arrays([*[kept.column(c) for c in ("row", "doc_id", "item", "item_id")], *columns], ["row", "doc_id", "item", "item_id", "score", "start_word", "end_word"])


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.5, seed_words: int = 3, pad: float = 0.5, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word) for every row and item whose alignment reaches ``threshold``.

    score is the best local alignment's score as a share of the item's own, and the words from start_word up to
    end_word hold it; of equal scores the first place counts. A copy is found if it keeps ``seed_words`` consecutive
    words of its item. Null and empty texts and items match nothing, nor do items of fewer than ``seed_words`` words,
    which are too short to tell a copy from chance; repeated rows and ids each count; columns besides id and text are
    not read. Texts are gone through once, however many items there are.
    """
    rows = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    known, _ = write_table(item_seeds(items, seed_words), "items")
    seeds = known.select("item", F.posexplode("seeds").alias("at", "seed"), F.expr("length(words) div 8").alias("size"))
    told = Filter.of(seeds)
    found = map_arrow(rows, lambda b: _places(b, told, seed_words), "doc_id long, words binary, seeds array<long>, places array<long>")
    seen, _ = write_table(found.withColumn("row", F.monotonically_increasing_id()), "places")
    hits = seen.select("row", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("row", F.col("s.seeds").alias("seed"), F.col("s.places").alias("place"))
    start = F.col("place") - F.col("at")
    met = hits.join(seeds, "seed").select("row", "item", "size", start.alias("start"), F.floor(start / F.col("size")).alias("part"))
    # seeds of one item that put its beginning at places less than its length apart are one passage
    near = met.groupBy("row", "item", "size", "part").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    room = F.floor(F.col("size") * pad) + 4
    near = near.select("row", "item", F.greatest(F.col("low") - room, F.lit(0)).alias("low"), (F.col("high") + F.col("size") + room).alias("high"))
    texts = seen.select("row", "doc_id", "words").join(near, "row").withColumn("passage", F.expr("substring(words, cast(8 * low + 1 as int), cast(8 * (high - low) as int))")).drop("words")
    pairs = texts.join(known.select("item", "item_id", F.col("words").alias("own")), "item").select("row", "doc_id", "item", "item_id", "low", "own", "passage")
    scored = map_arrow(pairs, lambda b: _align_rows(b, threshold), "row long, doc_id long, item long, item_id long, score double, start_word long, end_word long")
    best = F.max(F.struct("score", (-F.col("start_word")).alias("back"), "end_word", "doc_id", "item_id"))
    return scored.groupBy("row", "item").agg(best.alias("b")).select("b.doc_id", "b.item_id", "b.score", (-F.col("b.back")).alias("start_word"), "b.end_word")


def without_contaminated(docs: DataFrame, items: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that hold no item, by contaminated(), with all of their columns.

    Rows are judged one by one, by a number of their own and not by their ids; rows with null or empty texts stay.
    """
    name = "_" * (max(map(len, docs.columns)) + 1)
    rows, _ = write_table(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
    # written first: its size then tells whether it can be broadcast or all texts have to be shuffled to it
    gone, _ = write_table(contaminated(rows, items, **{**settings, "id_column": name}).select(F.col("doc_id").alias(name)).distinct(), "gone")
    return rows.join(gone, name, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
