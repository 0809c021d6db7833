"""Removal of repeated passages: words in a window of words that also starts earlier.

Anchors are hashes of ``anchor`` words at positions whose remainder modulo PERIOD lies in COVER, a difference cover:
for any two positions there is a shift below PERIOD that takes both into the cover. So two equal windows share an
anchor at the same shift, and a window without a repeated anchor can't be repeated. Anchors of the whole table, in
buckets by hash, tell which ones repeat; only windows around those are extended to 128-bit digests of their words,
whose earliest places decide. An anchor's 64-bit hash that two passages share by chance only leads to a look at both.
Texts are never shuffled: they are written once in blocks, every pass reads the blocks and gets back one bit for each
value that it sent. A block sends a value once, however often it holds it, so a passage found in a third of all
documents weighs no more than the number of blocks: 8 bytes for 4 MB of text in the first pass, 32 in the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, map_arrow, write_table
from .wordarrays import U, Words, inside_rows, row_numbers, slices, text_buffers, window_digests, window_hashes

PERIOD, COVER = 13, (0, 1, 3, 9)
_FLAGS = "block long, part int, bucket int, bits binary"
_SENT = ["bucket", "block", "hashes", "lower", "ids"]


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[pa.RecordBatch]:
    """One row for each run of rows of about ``block_bytes`` of text."""
    part, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        _, offsets = text_buffers(batch.column("text"))
        rows = pa.StructArray.from_arrays(batch.columns, fields=list(batch.schema))
        for i, j in slices(offsets, block_bytes):
            yield pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | made]), pa.array([part], pa.int32()), pa.array([int(offsets[j] - offsets[i])]), pa.ListArray.from_arrays(pa.array([0, j - i], pa.int32()), rows.slice(i, j - i))],
                ["block", "part", "bytes", "rows"],
            )
            made += 1


class _Block:
    """The words of a block, its anchors and, given the flags of repeated ones, the windows to look at."""

    def __init__(self, ids: pa.Array, texts: pa.Array, window: int):
        self.window, self.anchor = window, window - PERIOD + 1
        self.words = Words(*text_buffers(texts))
        first = self.words.first
        self.hashes = self.words.hashes()
        self.row = row_numbers(first)
        place = np.arange(len(self.hashes)) - first[self.row]
        cover = np.zeros(PERIOD, bool)
        cover[list(COVER)] = True
        n = max(len(self.hashes) - self.anchor + 1, 0)
        self.at = np.flatnonzero(cover[place[:n] % PERIOD] & inside_rows(first, self.anchor))
        own = window_hashes(self.hashes, self.anchor)[self.at]
        self.anchors, self.which, self.count = np.unique(own, return_inverse=True, return_counts=True)
        self.ids = ids.cast(pa.int64()).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)

    def extend(self, repeated: np.ndarray) -> None:
        """Digests of the windows that hold a repeated anchor: distinct ones, and each one's earliest place."""
        n = len(self.hashes)
        hit = np.zeros(n + 1, np.int32)
        hit[self.at[(repeated | (self.count > 1))[self.which]]] = 1
        total = np.concatenate(([0], np.cumsum(hit)))
        starts = np.arange(max(n - self.window + 1, 0))
        near = total[starts + PERIOD] > total[starts]
        self.starts = np.flatnonzero(near & inside_rows(self.words.first, self.window))
        high, low = window_digests(self.words.digests(np.flatnonzero(self._covered(self.starts))), self.starts, self.window)
        ids = self.ids[self.row[self.starts]]
        order = np.lexsort((self.starts, ids, low, high))
        head = _changes(high[order], low[order])
        at = order[head]
        self.windows, self.lower, self.owners = high[at], low[at], ids[at]
        self.order, self.head = order, head

    def removed(self, earliest: np.ndarray) -> np.ndarray:
        """Which words lie in a window that starts earlier elsewhere; ``earliest``: hashes whose first place is here."""
        stays = np.zeros(len(self.order), bool)
        stays[self.order[self.head]] = earliest
        return self._covered(self.starts[~stays])

    def _covered(self, starts: np.ndarray) -> np.ndarray:
        """Which words lie in a window that begins at one of ``starts``."""
        edge = np.zeros(len(self.hashes) + 1, np.int32)
        edge[starts] += 1
        edge[np.minimum(starts + self.window, len(self.hashes))] -= 1
        return np.cumsum(edge)[:-1] > 0


def _changes(*values: np.ndarray) -> np.ndarray:
    """Where sorted values differ from those before; the first place does."""
    out = np.ones(len(values[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in values], axis=0)
    return out


def _buckets(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Offsets of each bucket in ascending hashes; a bucket is a range of the upper 32 bits."""
    upper = (hashes >> U(32)) * U(buckets) >> U(32)
    return np.searchsorted(upper, np.arange(buckets + 1, dtype=U))


def _sent(block: int, hashes: np.ndarray, buckets: int, *more: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket: its hashes, and what goes with them."""
    cut = _buckets(hashes, buckets)
    full = np.flatnonzero(cut[1:] > cut[:-1])
    columns = [pa.array([x[cut[k] : cut[k + 1]].tobytes() for k in full], pa.binary()) for x in (hashes, *more)]
    columns += [pa.array([b""] * len(full), pa.binary())] * (3 - len(columns))
    return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(np.full(len(full), block)), *columns], _SENT)


def _judge(table: pa.Table) -> pa.Table:
    """For each block's hashes in one bucket a bit: repeated in another block, or of digests with ids, earliest here."""
    blocks = table.column("block").to_numpy()
    values = lambda name, kind: [np.frombuffer(x.as_buffer(), kind) for c in table.column(name).chunks for x in c]
    parts = values("hashes", U)
    sizes = np.array([len(x) for x in parts])
    hashes = np.concatenate(parts)
    flag = np.zeros(len(hashes), bool)
    ids = np.concatenate(values("ids", np.int64))
    if len(ids):
        lower = np.concatenate(values("lower", U))
        order = np.lexsort((np.repeat(blocks, sizes), ids, lower, hashes))
        flag[order] = _changes(hashes[order], lower[order])
    else:
        order = np.argsort(hashes, kind="stable")
        s = hashes[order]
        same = s[1:] == s[:-1]
        flag[order[1:][same]] = flag[order[:-1][same]] = True
    cut = np.concatenate(([0], np.cumsum(sizes)))
    bits = [np.packbits(flag[a:b]).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": blocks, "part": pa.array(blocks >> 32, pa.int32()), "bucket": table.column("bucket").cast(pa.int32()), "bits": pa.array(bits, pa.binary())})


class _Flags:
    """Reads back the bits for a block, from the folder of its part."""

    def __init__(self, path: str):
        self.path, self.part, self.have = path, None, {}

    def of(self, block: int, hashes: np.ndarray, buckets: int) -> np.ndarray:
        part = block >> 32
        if part != self.part:
            import pyarrow.parquet as pq
            from pyarrow import fs as pafs

            fs, root = filesystem(self.path)
            self.part, self.have, folder = part, {}, f"{root}/part={part}"
            found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
            for info in (x for x in found if x.path.endswith(".parquet")):
                with fs.open_input_file(info.path) as f:
                    for row in pq.ParquetFile(f).read(["block", "bucket", "bits"]).to_pylist():
                        self.have[row["block"], row["bucket"]] = row["bits"]
        cut, out = _buckets(hashes, buckets), np.zeros(len(hashes), bool)
        for k in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
            bits = np.frombuffer(self.have[block, k], np.uint8)
            out[cut[k] : cut[k + 1]] = np.unpackbits(bits)[: cut[k + 1] - cut[k]]
        return out


def substring_dedup(docs: DataFrame, *, window: int = 20, id_column: str = "doc_id", text_column: str = "text", block_bytes: int = 4 << 20, bucket_hashes: int = 1 << 20) -> DataFrame:
    """The rows of ``docs`` with n_words, n_removed and kept, the words that stay joined by one space.

    A word goes if a window of ``window`` words over it, all in one row, has the same words as a window that starts
    earlier: in a row of smaller id, or in the same row. Windows are judged on the input. Null and empty texts have no
    words and an empty ``kept``; a null id is the smallest; rows of equal id count as one after another, in an
    arbitrary but fixed order; an empty table gives no rows. Input columns named like the new ones are replaced.
    """
    if window < PERIOD:
        raise ValueError(f"window must be {PERIOD} words at least")
    spark = docs.sparkSession
    new = ("n_words", "n_removed", "kept")
    keep = [c for c in docs.columns if c not in (id_column, text_column, *new)]
    never = "_" * (max(map(len, docs.columns)) + 1)  # a struct needs a field, and none of ``docs`` has this name
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"), F.struct(F.lit(1).alias(never), *[F.col(f"`{c}`") for c in keep]).alias("rest"))
    kind = f"block long, part int, bytes long, rows array<struct<id: bigint, text: string, rest: {rows.schema['rest'].dataType.simpleString()}>>"
    kept_rows, _ = write_table(map_arrow(rows, lambda b: _blocks(b, block_bytes), kind), "blocks")
    total = kept_rows.agg(F.sum("bytes")).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(total / 16 / bucket_hashes) + 1)  # a word takes some 5 bytes, 4 of 13 are anchors
    slim = kept_rows.select("block", F.col("rows.id").alias("id"), F.col("rows.text").alias("text"))

    def blocks(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.column("block")[k].as_py(), _Block(batch.column("id")[k].values, batch.column("text")[k].values, window)

    def anchors(batches):
        for name, block in blocks(batches):
            yield _sent(name, block.anchors, buckets)

    def judged(fn, name):
        sent = map_arrow(slim, fn, "bucket int, block long, hashes binary, lower binary, ids binary").repartition(buckets, "bucket")
        told = sent.groupBy("bucket").applyInArrow(_judge, _FLAGS)
        return write_table(told.repartition(buckets, "part"), name, "part")[1]

    first = judged(anchors, "repeats")

    def windows(batches):
        flags = _Flags(first)
        for name, block in blocks(batches):
            block.extend(flags.of(name, block.anchors, buckets))
            if len(block.windows):
                yield _sent(name, block.windows, buckets, block.lower, block.owners)

    second = judged(windows, "earliest")

    def clean(batches):
        flags, owns = _Flags(first), _Flags(second)
        for batch in batches:
            for k in range(batch.num_rows):
                held, name = batch.column("rows")[k].values, batch.column("block")[k].as_py()
                ids, texts, rest = held.flatten()
                block = _Block(ids, texts, window)
                block.extend(flags.of(name, block.anchors, buckets))
                gone = block.removed(owns.of(name, block.windows, buckets))
                at, data = block.words.first, block.words.data
                _, offsets = text_buffers(texts)
                kept = []
                for r in range(len(texts)):
                    words = data[offsets[r] : offsets[r + 1]].tobytes().split()
                    mask = gone[at[r] : at[r + 1]]
                    kept.append(b" ".join(compress(words, (~mask).tolist()) if mask.any() else words).decode())
                removed = np.add.reduceat(np.append(gone, False), at[:-1]) if len(at) > 1 else np.zeros(0)
                removed = np.where(np.diff(at) > 0, removed, 0)
                yield pa.RecordBatch.from_arrays([ids, texts, rest, pa.array(np.diff(at)), pa.array(removed.astype(np.int64)), pa.array(kept, pa.string())], ["id", "text", "rest", *new])

    out = map_arrow(kept_rows, clean, rows.schema.add("n_words", "long").add("n_removed", "long").add("kept", "string"))
    shown = {id_column: F.col("id"), text_column: F.col("text")} | {c: F.col(f"rest.`{c}`") for c in keep}
    return out.select(*[shown[c].alias(c) for c in docs.columns if c in shown], *new)
