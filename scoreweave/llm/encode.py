"""Exact token ids by a tokenizers file, encoded once per distinct piece of a word.

The vocabulary file lower-cases, drops white space, and splits words into runs of letters, single
digits and runs of other signs before it merges. A text's ids are therefore its pieces' ids in a
row, where pieces end at ASCII white space and between a letter and an ASCII sign (but for the
apostrophe, which belongs to some contractions). A worker keeps the ids of pieces it has met. A file
with another normalizer or splitter, and a text that holds a special token's string, is encoded
whole by the library.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from .words import LOWER, SPACED, bytes_of, spans

_LETTER, _SIGN = 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[65:91] = _KIND[97:123] = _LETTER
for _a, _b in ((33, 39), (40, 48), (58, 65), (91, 97), (123, 127)):
    _KIND[_a:_b] = _SIGN
# Byte-level vocabularies write a byte as the character of its number, or, where that is a space or
# a control, as the next character from number 256 on.
_BYTE_SIGNS = {b: chr(256 + i) for i, b in enumerate([*range(33), *range(127, 161), 173])}


def _cuts(raw: np.ndarray) -> np.ndarray:
    """Positions between a letter (ASCII or Latin-1) and an ASCII sign, in either order."""
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # the signs among these letters: times and division
    kind[lead] = kind[lead + 1] = _LETTER
    return np.flatnonzero((kind[1:] | kind[:-1]) == _LETTER | _SIGN) + 1


#: The normalizer and splitter of a file whose texts may be encoded piece by piece.
_SPLITS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class TextEncoder:
    """ids of whole texts, as the library's plain call has them, by that call: for files of any kind."""

    def __init__(self, tokenizer):
        self._tokenizer = tokenizer

    def whole(self, texts: list[bytes]) -> list[np.ndarray]:
        got = self._tokenizer.encode_batch_fast([t.decode("utf-8", "replace") for t in texts], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """An Arrow string column's ids, one text after another, and where each text begins (with the end)."""
        ids = self.whole(texts_of(column))
        return np.concatenate([*ids, np.empty(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in ids], dtype=np.int64)])


class PieceEncoder(TextEncoder):
    """The same ids for files with the normalizer and splitter of _SPLITS, each distinct piece encoded once.

    The ids of pieces met stay in one table, found by the piece's 64-bit hash; a full table starts
    anew. A text that holds the string of a special token is encoded whole.
    """

    def __init__(self, tokenizer, special: list[bytes], most_pieces: int = 1_000_000):
        super().__init__(tokenizer)
        self._merge, self._special, self._most = tokenizer.model.tokenize, special, most_pieces
        self._clear()

    def _clear(self) -> None:
        self._hash, self._begin, self._size = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self._ids, self._used = np.empty(1 << 16, np.uint32), 0

    def _merged(self, pieces: list[bytes]) -> list[bytes]:
        """ids per lower-cased piece, as native unsigned 32-bit."""
        out, merge, rest = [b""] * len(pieces), self._merge, []
        for i, p in enumerate(pieces):
            if p.isalpha():  # ASCII letters alone
                word = p.decode()
            elif p.isascii():
                word = ""
            else:
                word = p.decode("utf-8", "replace").lower()
                word = word.encode().decode("latin-1").translate(_BYTE_SIGNS) if word.isalpha() and max(word) < "\u0100" else ""
            if word:  # one run of letters, in composed form: it goes to the merges as it is
                out[i] = array("I", [t.id for t in merge(word)]).tobytes()
            else:
                rest.append(i)
        for i in range(0, len(rest), 10_000):
            part = rest[i : i + 10_000]
            for j, ids in zip(part, self.whole([pieces[j] for j in part]), strict=True):
                out[j] = ids.tobytes()
        return out

    def _look_up(self, hashes: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """Begin and number of the ids of sorted distinct pieces; piece(indices) gives the bytes of those not met before."""
        if len(self._hash) > self._most:
            self._clear()
        at = np.searchsorted(self._hash, hashes)
        met = np.zeros(len(hashes), bool)
        inside = at < len(self._hash)
        met[inside] = self._hash[at[inside]] == hashes[inside]
        new = np.flatnonzero(~met)
        if len(new):
            found = self._merged(piece(new))
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            more = np.frombuffer(b"".join(found), np.uint32)
            if self._used + len(more) > len(self._ids):
                self._ids = np.concatenate([self._ids[: self._used], np.empty(max(len(more), len(self._ids)), np.uint32)])
            self._ids[self._used : self._used + len(more)] = more
            self._hash = np.insert(self._hash, at[new], hashes[new])
            self._begin = np.insert(self._begin, at[new], self._used + np.cumsum(sizes) - sizes)
            self._size = np.insert(self._size, at[new], sizes)
            self._used += len(more)
            at = np.searchsorted(self._hash, hashes)
        return self._begin[at], self._size[at]

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        raw, starts = bytes_of(column)
        data = LOWER[raw].tobytes()
        s = spans(raw, starts, SPACED, lower=True, cuts=_cuts(raw) if len(raw) > 1 else None)
        ids, at = np.empty(0, np.uint32), np.zeros(len(starts), np.int64)
        if len(s.hash):
            distinct, first, which = np.unique(s.hash, return_index=True, return_inverse=True)
            begins, sizes = self._look_up(distinct,
                lambda new: [data[a:b] for a, b in zip(s.start[first[new]].tolist(), s.end[first[new]].tolist(), strict=True)])
            n = sizes[which]
            ends = np.cumsum(n)
            ids = self._ids[np.arange(ends[-1]) + np.repeat(begins[which] - (ends - n), n)]
            at = np.concatenate([[0], ends])[np.searchsorted(s.start, starts)]
        return self._with_special(raw, starts, ids, at, data)

    def _with_special(self, raw, starts, ids, at, data) -> tuple[np.ndarray, np.ndarray]:
        """The same with the texts that hold a special token's string encoded whole."""
        if not any(t.lower() in data for t in self._special):
            return ids, at
        texts = [raw[a:b].tobytes() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        parts = [ids[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        rows = [i for i, t in enumerate(texts) if any(x in t for x in self._special)]
        for i, own in zip(rows, self.whole([texts[i] for i in rows]), strict=True):
            parts[i] = own
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    """One per Python worker; by pieces only for a file that splits as _cuts does."""
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        said = json.loads(tokenizer.to_str())
        special = [t["content"] for t in said["added_tokens"]]
        # Pieces end between a letter and a sign, so none of them holds a string that has both side by side.
        by_pieces = all(said[k] == v for k, v in _SPLITS.items()) and all(re.search(r"[A-Za-z][|<>]|[|<>][A-Za-z]", t) for t in special)
        _encoders[path] = PieceEncoder(tokenizer, [t.encode() for t in special]) if by_pieces else TextEncoder(tokenizer)
    return _encoders[path]


def texts_of(column) -> list[bytes]:
    """An Arrow string column as bytes; null: empty."""
    import pyarrow as pa

    return [b"" if t is None else t for t in column.cast(pa.large_binary()).to_pylist()]


def in_slices(batch, text_col: str, most_bytes: int = 8 << 20):
    """Slices of a batch with a bounded number of text bytes (a single longer text stands alone)."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most_bytes, "right")))
        yield batch.slice(start, stop - start)
        start = stop
