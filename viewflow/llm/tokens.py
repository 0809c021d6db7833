"""Token ids of whole Arrow batches by a public tokenizer, with a memo of pieces already encoded.

A batch is cut only where every pre-tokenizer of the supported files cuts as well: before a space or line feed that
follows a visible character, and between an ASCII letter and ASCII punctuation other than an apostrophe. Arrow's
dictionary encoder reduces the pieces to distinct ones, the tokenizers library encodes those not met before, and
numpy gathers the ids. The ids are those of encoding the whole text at once. What strings of special tokens become is
the caller's choice: the tokens themselves, as the library does unless told otherwise, or ordinary text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .wordarrays import slices, text_buffers

_LETTER, _MARK, _VISIBLE = (np.zeros(256, bool) for _ in range(3))
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in "'"]] = True
_VISIBLE[0x21:0x7F] = True
_coders: dict[tuple, Coder] = {}


def tokenizer_path(name: str) -> str:
    """A file's place: a path as it is, or the name of one of the installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def coder(name: str, special_as_text: bool = False) -> Coder:
    """This process's coder for a tokenizer file; its memo lives as long as the process."""
    key = (name, special_as_text)
    if key not in _coders:
        _coders[key] = Coder(name, special_as_text)
    return _coders[key]


def forget() -> None:
    """Drop this process's coders and their memos."""
    _coders.clear()


def _byte_chars() -> dict[int, int]:
    """The character that byte-level files use for each byte: printable ones stand for themselves, the others follow 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}


class Coder:
    """Encodes columns of text; ``memo_entries`` bounds the pieces remembered, not what is encoded.

    Texts with a special token's string in them are encoded whole, unless ``special_as_text``.
    """

    def __init__(self, name: str, special_as_text: bool = False, memo_entries: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(name))
        self.tokenizer.encode_special_tokens = special_as_text
        self.width = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        self.model = self.tokenizer.model
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = None if special_as_text or not special else "|".join(map(re.escape, special))
        self.lower = "lowercase" in str(self.tokenizer.normalizer).lower()
        self.byte_chars = _byte_chars()
        self.memo: dict[str, bytes] = {}
        self.memo_entries = memo_entries

    def encode_rows(self, column: pa.Array, end: int | None = None):
        """Yield (rows from, rows to, ids of these rows one after another, ids per row), slice by slice."""
        data, offsets = text_buffers(column)
        whole = np.zeros(0, np.int64)
        if self.special:
            whole = np.flatnonzero(pc.match_substring_regex(column, self.special, ignore_case=self.lower).fill_null(False).to_numpy(zero_copy_only=False))
        for i, j in slices(offsets):
            ids, counts = self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own = whole[(whole >= i) & (whole < j)]
            if len(own):
                rows = np.split(ids, np.cumsum(counts)[:-1])
                for r in own.tolist():
                    rows[r - i] = np.array(self.tokenizer.encode(column[r].as_py(), add_special_tokens=False).ids, self.width)
                ids, counts = np.concatenate(rows), np.array([len(x) for x in rows], np.int64)
            if end is not None:
                ids = np.insert(ids, np.cumsum(counts), self.width.type(end))
                counts = counts + 1
            yield i, j, ids, counts

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        if not n:
            return np.zeros(0, self.width), np.zeros(len(offsets) - 1, np.int64)
        mark = np.zeros(n + 1, bool)
        prev, here = data[:-1], data[1:]
        at = np.flatnonzero((here == 0x20) | (here == 0x0A)) + 1
        before = data[at - 1]
        two, three = data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)]
        # a character of several bytes may be a space itself: those begin with C2, E1, E2 or E3
        mark[at[_VISIBLE[before] | ((before >= 0x80) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))]] = True
        mark[np.flatnonzero(_LETTER[prev] & _MARK[here]) + 1] = True
        mark[offsets[:-1]] = True
        starts = np.flatnonzero(mark[:n])
        ends = np.append(starts, n).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data)))
        coded = pieces.dictionary_encode()
        known = self._ids(coded.dictionary.to_pylist())
        size = np.fromiter(map(len, known), np.int64, len(known)) // self.width.itemsize
        flat, begin = np.frombuffer(b"".join(known), self.width), np.cumsum(size) - size
        which = coded.indices.to_numpy()
        counts = size[which]
        total = np.concatenate(([0], np.cumsum(counts)))
        ids = flat[np.repeat(begin[which] - total[:-1], counts) + np.arange(total[-1])]
        return ids, np.diff(total[np.searchsorted(starts, offsets)])

    def _ids(self, pieces: list[str]) -> list[bytes]:
        memo = self.memo
        found = [memo.get(p) for p in pieces]
        missing = [k for k, x in enumerate(found) if x is None]
        rest, tokenize, kind = [], self.model.tokenize, "H" if self.width.itemsize == 2 else "I"
        for k in missing:
            piece = pieces[k]
            word = piece[1:] if piece[0] == " " else piece
            if word.isalpha() and max(word) < "\u0130":  # one word, which only the model itself has to cut
                word = word.lower() if self.lower else piece
                found[k] = array(kind, [t.id for t in tokenize(word.encode().decode("latin-1").translate(self.byte_chars))]).tobytes()
            else:
                rest.append(k)
        for at in range(0, len(rest), 20_000):
            part = rest[at : at + 20_000]
            for k, e in zip(part, self.tokenizer.encode_batch_fast([pieces[k] for k in part], add_special_tokens=False), strict=True):
                found[k] = np.array(e.ids, self.width).tobytes()
        for k in missing[: max(0, self.memo_entries - len(memo))]:
            memo[pieces[k]] = found[k]
        return found
