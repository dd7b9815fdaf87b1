"""Words of many texts at once: numpy passes over the bytes of an Arrow column, no object per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

SEGMENT = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so that its powers can be undone modulo 2**64
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

#: Words between ASCII white space; words of letters and digits (bytes of other alphabets count as letters).
SPACED = np.ones(256, bool)
SPACED[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, bool)
LETTERS[48:58] = LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True
LINES = np.ones(256, bool)
LINES[10] = False
#: A-Z to a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            steps = np.full(n, b, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every bit of the input reaches every bit of the result."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string column and each text's start (with the end of the last); null: empty."""
    import pyarrow as pa

    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


@dataclass
class Spans:
    """Words (or lines) in order: hash, first byte, byte after the last, and the row of the text."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray


def spans(raw: np.ndarray, starts: np.ndarray, inside: np.ndarray | None, lower: bool = False, empty: bool = False, cuts: np.ndarray | None = None,
        keep: np.ndarray | None = None) -> Spans:
    """Runs of bytes marked inside, never across texts, hashed in segments of bounded size.

    keep: the marks of the bytes where they stand, in place of inside, which marks bytes by their value.
    empty: also the empty runs between two marks, as a split at single bytes has them.
    cuts: sorted positions before which a run ends as well.
    """
    n = len(raw)
    keep = inside[raw] if keep is None else keep
    if empty:
        cut = np.flatnonzero(~keep)
        begin = np.sort(np.concatenate([starts[:-1], cut + 1]))
        end = np.sort(np.concatenate([starts[1:], cut]))
    else:
        first, last = keep.copy(), keep.copy()
        first[1:] &= ~keep[:-1]
        last[:-1] &= ~keep[1:]
        edges = starts[1:-1] if cuts is None else np.concatenate([starts[1:-1], cuts])
        edges = edges[(edges > 0) & (edges < n)]
        both = edges[keep[edges] & keep[edges - 1]]
        first[both] = True
        last[both - 1] = True
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    if empty:
        counts = np.diff(np.searchsorted(cut, starts)) + 1
        row = np.repeat(np.arange(len(starts) - 1), counts)
    else:
        row = np.searchsorted(starts, begin, "right") - 1
    hashes = np.zeros(len(begin), np.uint64)
    with np.errstate(over="ignore"):
        i = 0
        while i < len(begin):
            base = int(begin[i])
            j = max(i + 1, int(np.searchsorted(end, base + SEGMENT, "right")))
            top = int(end[j - 1])
            up, down = _power(top - base + 1)
            part = raw[base:top]
            part = LOWER[part] if lower else part
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
            a, b = begin[i:j] - base, end[i:j] - base
            hashes[i:j] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
            i = j
    return Spans(hashes, begin, end, row)


def shingles(s: Spans, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k words in a row and the index of each one's first word, within texts only."""
    n = len(s.hash) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    at = np.flatnonzero(s.row[:n] == s.row[k - 1 :])
    with np.errstate(over="ignore"):
        h = s.hash[at]
        for j in range(1, k):
            h = mix(h * np.uint64(0xD6E8FEB86659FD93) + s.hash[at + j])
    return h, at


def repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys occur twice or more, and which of them are not the first."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    same = ordered[1:] == ordered[:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:][same]] = True
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, later


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)
