"""Token-id files: one flat id array per shard beside an Elias-Fano coded list of document ends.

A shard holds the documents of one doc_id range in ascending order: its ``.ids`` file is the little-endian ids and
nothing else, its ``.ef`` file the document ends (ids up to and with each document) and the doc_ids. A monotone list
of n numbers below u takes about 2 + log2(u / n) bits each: low bits in a packed array, high bits in unary in a bit
vector, and every 256th one's place as select samples, so any entry is found without a table of 64-bit offsets.
Readers select what they need: a run of documents at a time, or the two ends of a single one.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, map_arrow, new_path, partitions_for
from .tokens import coder

SAMPLE = 256
_MANIFEST = "shard long, docs long, tokens long, first long, base long, path string"
_DOCUMENT = "doc_id long, start long, n_tokens long, ids binary"


class EliasFano:
    """A non-decreasing list of non-negative integers; ``select(i)`` is its i-th entry."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, np.zeros(0, np.uint8), np.zeros(0, np.uint8), np.zeros(0, np.uint64))
        bits = max(0, int(int(values[-1]) // n).bit_length() - 1)
        low = np.zeros(0, np.uint8)
        if bits:
            parts = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
            low = np.packbits(parts.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        vector = np.zeros(int(ones[-1]) + 1, np.uint8)
        vector[ones] = 1
        return cls(n, bits, low, np.packbits(vector, bitorder="little"), ones[::SAMPLE].astype(np.uint64))

    def slice(self, i: int, j: int) -> np.ndarray:
        """Entries i up to j, found from the nearest sample before them; nothing else is decoded."""
        if not 0 <= i <= j <= self.n:
            raise IndexError(i, j)
        if i == j:
            return np.zeros(0, np.int64)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte, need = at >> 3, left + j - i
        span = 64 + need // 2
        while True:
            ones = np.flatnonzero(np.unpackbits(self.high[byte : byte + span], bitorder="little")) + byte * 8
            ones = ones[ones >= at]
            if len(ones) >= need:
                break
            span *= 2
        out = (ones[left:need] - np.arange(i, j)) << self.low_bits
        if self.low_bits:
            first, last = i * self.low_bits, j * self.low_bits
            got = np.unpackbits(self.low[first >> 3 : (last + 7) >> 3], bitorder="little")[first & 7 :][: last - first]
            out += got.reshape(j - i, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def select(self, i: int) -> int:
        """Entry i."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.slice(i, i + 1)[0])

    def to_bytes(self) -> bytes:
        body = self.low.tobytes(), self.high.tobytes(), self.samples.astype("<u8").tobytes()
        return struct.pack("<QBQQQ", self.n, self.low_bits, *map(len, body)) + b"".join(body)

    @classmethod
    def from_bytes(cls, raw: bytes) -> tuple[EliasFano, bytes]:
        """The list at the front of ``raw``, and what follows it."""
        n, bits, *sizes = struct.unpack_from("<QBQQQ", raw)
        at, parts = struct.calcsize("<QBQQQ"), []
        for size in sizes:
            parts.append(raw[at : at + size])
            at += size
        low, high = (np.frombuffer(x, np.uint8) for x in parts[:2])
        return cls(n, bits, low, high, np.frombuffer(parts[2], "<u8")), raw[at:]


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end: int, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write every document's ids, then ``end``, in ascending id order; one manifest row per shard.

    The manifest has shard, docs, tokens, first and base (documents and ids in all shards before) and the files'
    common path. Spark's range partitioning deals out the texts, which are shuffled once and tokenized once. A retried
    task writes files of another name, and only what a finished task reported is in the manifest, so readers never see
    half a file and nothing is renamed. Null texts are empty, and special tokens' strings become these tokens; null ids
    come first; equal ids stand side by side in order of their texts' hashes, and wholly equal rows may lie in two
    shards; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    # hashes split rows of equal id, and numbers rows that are equal altogether, whose order doesn't matter
    order = F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    ordered = rows.repartitionByRange(partitions_for(rows), *order).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(tokenizer)
        ids_file, shard = None, TaskContext.get().partitionId()
        names, sizes, nulls = [], [], 0
        fs, root = filesystem(folder)
        name = f"{shard:06d}-{uuid.uuid4().hex}"
        path = posixpath.join(root, name)
        for batch in batches:
            if ids_file is None and batch.num_rows:
                ids_file = fs.open_output_stream(path + ".ids")
            keys = batch.column("doc_id")
            nulls += keys.null_count
            names.append(keys.drop_null().to_numpy())
            for _, _, ids, counts in code.encode_rows(batch.column("text"), end):
                ids_file.write(ids.tobytes())
                sizes.append(counts)
        if ids_file is None:
            return
        ids_file.close()
        names, ends = np.concatenate(names), np.cumsum(np.concatenate(sizes))
        least = int(names[0]) if len(names) else 0
        with fs.open_output_stream(path + ".ef") as f:
            f.write(struct.pack("<BQq", code.width.itemsize, nulls, least))
            f.write(EliasFano.of(ends).to_bytes() + EliasFano.of(names - least).to_bytes())
        yield pa.RecordBatch.from_pydict({"shard": [shard], "docs": [len(ends)], "tokens": [int(ends[-1])], "file": [name]})

    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    made = sorted(map_arrow(ordered, write, "shard long, docs long, tokens long, file string", tokenizes=True).collect())  # a row for each shard
    first, base, manifest = 0, 0, []
    for row in made:
        manifest.append((row.shard, row.docs, row.tokens, first, base, f"{folder}/{row.file}"))
        first, base = first + row.docs, base + row.tokens
    return spark.createDataFrame(manifest, _MANIFEST).repartition(max(1, len(manifest)))


class _Shard:
    """A shard's ends and names, still encoded, and its open file of ids."""

    def __init__(self, path: str):
        self.fs, self.path = filesystem(path)
        with self.fs.open_input_stream(self.path + ".ef") as f:
            raw = f.read()
        self.width, self.nulls, self.least = struct.unpack_from("<BQq", raw)
        self.ends, rest = EliasFano.from_bytes(raw[struct.calcsize("<BQq") :])
        self.names, _ = EliasFano.from_bytes(rest)

    def bounds(self, i: int, j: int) -> np.ndarray:
        """Where documents i up to j begin, and where the last of them ends."""
        return np.concatenate(([0], self.ends.slice(0, j))) if i == 0 else self.ends.slice(i - 1, j)

    def doc_ids(self, i: int, j: int) -> list[int | None]:
        known = self.names.slice(max(i - self.nulls, 0), max(j - self.nulls, 0)) + self.least
        return [None] * (min(j, self.nulls) - min(i, self.nulls)) + known.tolist()

    def open(self):
        return self.fs.open_input_file(self.path + ".ids")

    def ids(self, file, at: int, to: int) -> bytes:
        return np.frombuffer(file.read_at((to - at) * self.width, at * self.width), f"<u{self.width}").astype("<u4").tobytes()


def read_token_files(manifest: DataFrame, *, block_ids: int = 1 << 20) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian 32-bit) of every document in the files of a manifest."""
    return map_arrow(manifest, lambda batches: _read(batches, block_ids), _DOCUMENT)


def _read(batches, block_ids):
    for batch in batches:
        for row in batch.to_pylist():
            shard, i = _Shard(row["path"]), 0
            with shard.open() as f:
                while i < row["docs"]:
                    at = shard.bounds(i, min(i + 4096, row["docs"]))
                    j = i + max(1, int(np.searchsorted(at, at[0] + block_ids, "right")) - 1)
                    at = at[: j - i + 1]
                    ids, cut = shard.ids(f, int(at[0]), int(at[-1])), (at - at[0]) * 4
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(shard.doc_ids(i, j), pa.int64()),
                        "start": pa.array(at[:-1] + row["base"], pa.int64()),
                        "n_tokens": pa.array(np.diff(at), pa.int64()),
                        "ids": pa.array([ids[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
                    })
                    i = j


def documents_at(manifest: DataFrame, places: DataFrame) -> DataFrame:
    """The documents at some places in the order of all files: place, doc_id, start, n_tokens, ids.

    ``places`` has one column of numbers from 0. Each document costs two selects and one read of its own ids; places
    are sorted by file first, so a task opens few of them. Places that are null or hold nothing give no row, repeated
    ones a row each. The manifest, a row for each shard, is sent to the tasks.
    """
    shards = sorted(manifest.select("first", "docs", "base", "path").collect())
    firsts = np.array([r.first for r in shards], np.int64)

    def fetch(batches):
        shard, open_at, f = None, None, None
        for batch in batches:
            out = []
            for place in batch.column(0).to_pylist():
                k = int(np.searchsorted(firsts, place, "right")) - 1
                if k < 0 or place - shards[k].first >= shards[k].docs:
                    continue
                if k != open_at:
                    if f is not None:
                        f.close()
                    shard, open_at = _Shard(shards[k].path), k
                    f = shard.open()
                i = place - shards[k].first
                at, to = (shard.ends.select(i - 1) if i else 0), shard.ends.select(i)
                out.append((place, shard.doc_ids(i, i + 1)[0], at + shards[k].base, to - at, shard.ids(f, at, to)))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["place", "doc_id", "start", "n_tokens", "ids"])
        if f is not None:
            f.close()

    wanted = places.select(F.col(f"`{places.columns[0]}`").cast("long").alias("place")).where("place is not null")
    return map_arrow(wanted.repartitionByRange("place").sortWithinPartitions("place"), fetch, f"place long, {_DOCUMENT}")


def document_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the CRC-32 of each document's ids, read back from the files.

    Works beside read_token_files() without sending the ids through Spark.
    """

    def digest(batches):
        for batch in _read(batches, 1 << 20):
            sums = [zlib.crc32(x.as_buffer()) for x in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(manifest, digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(docs: DataFrame) -> str:
    """A new folder for token files among the shared ones."""
    return new_path(docs.sparkSession, "tokens")
