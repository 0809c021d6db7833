"""Sequences packed along a space-filling curve: neighbouring documents are alike.

Each document's words are hashed into a vector, projected to a few dimensions by a fixed random matrix and placed on a
Hilbert curve; documents are range-partitioned and sorted by their place, concatenated and cut every ``length`` ids.
Ranges hold about as many bytes of text each. The rest of a partition is cut at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_arrow, partitions_for, range_bounds
from .tokens import coder
from .wordarrays import U, Words, mix, row_numbers, slices, text_buffers

DIMS, BITS, HASHED = 4, 10, 64
_WEIGHT = 4096


def hilbert_key(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on a Hilbert curve of each row of ``cells``, whose columns are axes of ``bits`` bits."""
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    for level in range(bits - 1, 0, -1):  # undo the rotations and reflections, coarse to fine
        q, p = 1 << level, (1 << level) - 1
        for d in range(dims):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            if d:
                x[d] ^= swap
    for d in range(1, dims):  # Gray code
        x[d] ^= x[d - 1]
    fix = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        fix = np.where((x[-1] & (1 << level)) != 0, fix ^ ((1 << level) - 1), fix)
    x ^= fix
    key = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> level) & 1)
    return key


def curve_places(texts: pa.Array) -> np.ndarray:
    """Each text's Hilbert key, of DIMS * BITS bits; texts without words lie at the middle of the space."""
    data, offsets = text_buffers(texts)
    matrix = np.random.default_rng(7).standard_normal((HASHED, DIMS))
    out = []
    for i, j in slices(offsets):
        words = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lower=True)
        h = words.hashes()
        sign = np.where((h >> U(32)) & U(1), 1.0, -1.0)
        slot = row_numbers(words.first) * HASHED + (h % U(HASHED)).astype(np.int64)
        vector = np.bincount(slot, sign, (j - i) * HASHED).reshape(j - i, HASHED)
        norm = np.linalg.norm(vector, axis=1, keepdims=True)
        spread = (vector / np.where(norm == 0, 1, norm)) @ matrix  # about standard normal in each dimension
        cells = np.clip((1 / (1 + np.exp(-1.7 * spread))) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        out.append(hilbert_key(cells, BITS))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def _places(b: pa.RecordBatch) -> np.ndarray:
    """Places on the curve, and after them, for copies, 12 bits of the row's hash: 52 bits, which doubles hold exactly."""
    tie = b.column("tie").to_numpy().view(U)
    return curve_places(b.column("text")) << 12 | (mix(tie) & U((1 << 12) - 1)).astype(np.int64)


def _weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's place, once for every _WEIGHT bytes that it begins."""
    for b in batches:
        size = np.diff(text_buffers(b.column("text"))[1])
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(_places(b), 1 + size // _WEIGHT))], ["place"])


class Ranges:
    """Deals places out to ranges; a place that fills several is spread over them.

    Rows of such a place go in turn, counted for each row's hash, so a task that runs again deals out the same number
    of equal rows to each range, whatever order it meets them in.
    """

    def __init__(self, bounds: list[int]):
        self.bounds, self.met = np.array(bounds, np.int64), {}

    def of(self, places: np.ndarray, ties: np.ndarray) -> np.ndarray:
        low, out = np.searchsorted(self.bounds, places, "left"), np.searchsorted(self.bounds, places, "right")
        for k in np.flatnonzero(out - low > 1).tolist():
            tie = int(ties[k])
            turn = self.met[tie] = self.met.get(tie, -1) + 1
            out[k] = low[k] + (tie + turn) % (out[k] - low[k] + 1)
        return out


def pack_sequences(docs: DataFrame, tokenizer: str, end: int, *, length: int = 2048, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids (binary, 32-bit), doc_tokens, sequence_id, offset.

    A document's ids, then ``end``, lie in pieces in order, each id in one piece. Every sequence has ``length`` ids
    or a power of two of them, so none is padded. Copies share a place on the curve; a hash of id and text splits them
    over partitions, and rows that are equal altogether are dealt out in turn. Null texts are empty (the end id alone),
    special tokens' strings become these tokens, null and equal ids are packed like others, an empty table gives no
    rows, and columns besides id and text are not read.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "text"))
    weighed = map_arrow(rows, _weights, "place long", tokenizes=True)  # the next pass needs the memos again
    bounds = range_bounds(weighed, "place", partitions_for(rows))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, ranges = coder(tokenizer), Ranges(bounds)
        for b in batches:
            places = _places(b)
            parts = ranges.of(places, b.column("tie").to_numpy())
            for i, j, ids, counts in code.encode_rows(b.column("text"), end):
                at = np.concatenate(([0], np.cumsum(counts))).astype(np.int32) * code.width.itemsize
                packed = pa.BinaryArray.from_buffers(pa.binary(), j - i, [None, pa.py_buffer(at), pa.py_buffer(ids.tobytes())])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, j - i), pa.array(places[i:j]), pa.array(parts[i:j]), packed], ["doc_id", "place", "part", "packed"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = coder(tokenizer).width
        free, sequence, made = length, None, 0
        held, room = [], 0  # pieces of the sequence that is not full yet, as (doc_id, start, ids, doc_tokens)
        for b in batches:
            out = []
            for part, key, raw in zip(b.column("part").to_pylist(), b.column("doc_id").to_pylist(), b.column("packed"), strict=True):
                if sequence is None:
                    sequence = part << 40
                ids, at = np.frombuffer(raw.as_buffer(), width), 0
                while at < len(ids):
                    take = min(free - room, len(ids) - at)
                    held.append((key, at, ids[at : at + take], len(ids)))
                    room, at = room + take, at + take
                    if room == free:
                        out += _rows(held, sequence + made, 0)
                        held, room, made = [], 0, made + 1
            held = [(k, s, x.copy(), n) for k, s, x, n in held]
            yield from _batches(out)
        out = []
        while room:  # the rest: powers of two, the largest first
            size = 1 << (room.bit_length() - 1)
            now, left = [], size
            while left:
                key, at, ids, total = held.pop(0)
                now.append((key, at, ids[:left], total))
                if len(ids) > left:
                    held.insert(0, (key, at + left, ids[left:], total))
                left -= len(now[-1][2])
            out += _rows(now, sequence + made, 0)
            room, made = room - size, made + 1
        yield from _batches(out)

    coded = map_arrow(rows, encode, "doc_id long, place long, part long, packed binary", tokenizes=True)
    ranged = coded.repartitionById(len(bounds) + 1, F.col("part").cast("int")).sortWithinPartitions("part", "place", "doc_id")
    return map_arrow(ranged, cut, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long", tokenizes=True)


def _rows(pieces, sequence: int, offset: int) -> list[tuple]:
    out = []
    for key, at, ids, total in pieces:
        out.append((key, at, len(ids), ids.astype("<u4").tobytes(), total, sequence, offset))
        offset += len(ids)
    return out


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for k in range(0, len(rows), 2000):
        columns = zip(*rows[k : k + 2000], strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)], names)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """The pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def crc32(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of ids as little-endian 32-bit integers."""
    return zlib.crc32(np.asarray(ids).astype("<u4").tobytes())
