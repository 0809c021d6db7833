"""Words of whole Arrow batches as numpy arrays: where they stand, to which row they belong, what they hash to.

A word is a maximal run of bytes outside 0x20 and 0x09-0x0D, so multi-byte characters stay whole. Hashes mix a word's
bytes in eight at a time, each step a bijection, so words of up to eight bytes of one length never share one. Windows
of k words come in two kinds: window_hashes() are quick polynomials over the words' hashes, for finding candidates,
and window_digests() are 128 bits that chain the words' XXH3 digests one after another, for decisions. Only the
distinct words of these are gone through in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U = np.uint64
_WORD_BASE, _STEP = U(0xD6E8FEB86659FD93), U(0x9E3779B97F4A7C15)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits separates words.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LONG = 256  # longer words are hashed one by one
_TAILS = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # what belongs to a word in its last eight bytes
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(base: U, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i under n."""
    have = _powers.get(int(base))
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        up = np.full(m, base, U)
        up[0] = 1
        down = np.full(m, U(pow(int(base), -1, 1 << 64)), U)
        down[0] = 1
        have = np.cumprod(up, dtype=U), np.cumprod(down, dtype=U)
        if m <= 1 << 23:
            _powers[int(base)] = have
    return have[0][:n], have[1][:n]


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, row offsets) of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes at most; a longer row stands alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """The words of some rows: starts and ends in ``data``, and ``first``, the rows' offsets among the words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, spaces: np.ndarray = _SPACE):
        self.data = _LOWER[data] if lower else data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~spaces[data]
        before, after = inside[:-2].copy(), inside[2:].copy()
        cut = offsets[(offsets > 0) & (offsets < n)]
        before[cut] = False
        after[cut - 1] = False
        own = inside[1:-1]
        self.starts = np.flatnonzero(own & ~before)
        self.ends = np.flatnonzero(own & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes: eight at a time are mixed in, by a bijection, for all words that have them."""
        n = len(self.starts)
        size = self.ends - self.starts
        padded = np.zeros(len(self.data) + 8, np.uint8)
        padded[: len(self.data)] = self.data
        lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(self.data) + 1, 8), (1, 1))
        out = mix(size.astype(U) * _STEP)
        which, at, left = np.arange(n), self.starts, size
        for _ in range(_LONG // 8):
            lane = np.ascontiguousarray(lanes[at]).view("<u8").ravel() & _TAILS[np.minimum(left, 8)]
            out[which] = mix(out[which] ^ lane) + _STEP
            more = left > 8
            which, at, left = which[more], at[more] + 8, left[more] - 8
            if not len(which):
                break
        for k in which.tolist():
            out[k] = xxhash.xxh3_64_intdigest(self.data[self.starts[k] : self.ends[k]].tobytes())
        return out

    def digests(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """128-bit digests of the words ``at``, as arrays of upper and lower halves over all words, else zero."""
        n, size = len(self.starts), (self.ends - self.starts)[at]
        halves = np.zeros((n, 2), U)
        if len(at):
            ends = np.concatenate(([0], np.cumsum(size)))
            body = self.data[np.repeat(self.starts[at] - ends[:-1], size) + np.arange(ends[-1])]
            coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(body)]).dictionary_encode()
            raw = b"".join(xxhash.xxh3_128_digest(x.as_buffer()) for x in coded.dictionary)
            halves[at] = np.frombuffer(raw, ">u8").astype(U).reshape(-1, 2)[coded.indices.to_numpy()]
        return halves[:, 0], halves[:, 1]


def window_digests(digests: tuple[np.ndarray, np.ndarray], starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests, in two halves, of the windows of k words at ``starts``: equal only for equal words."""
    out = []
    for half, seed in zip(digests, (U(1), U(2)), strict=True):
        h = np.full(len(starts), seed, U)
        for i in range(k):
            h = mix((h + _STEP) ^ half[starts + i])
        out.append(h)
    return out[0], out[1]


def window_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive entries (also across rows: mask with inside_rows)."""
    n = len(words)
    if n < k:
        return np.zeros(0, U)
    up, down = powers(_WORD_BASE, n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(words * up[:n], dtype=U, out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def inside_rows(first: np.ndarray, k: int) -> np.ndarray:
    """For each window start, whether the window of k words ends in the row that it starts in."""
    n = int(first[-1])
    good = np.ones(max(n - k + 1, 0), bool)
    for back in range(1, k):  # a start less than k words before a row's end
        at = first[1:] - back
        good[at[(at >= 0) & (at < len(good))]] = False
    return good


def row_numbers(first: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))
