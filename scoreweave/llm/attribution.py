"""Token counts by section: whole documents are encoded once, and tokens are joined to character spans.

A byte-level vocabulary's tokens are stretches of the text's bytes, so a running sum of their
lengths gives every token's place. A document's sections are disjoint character spans in order. A
token belongs to the sections it overlaps: a boundary-crossing one is allotted to the section that
holds more of its bytes, and to the earlier of two with as many. A token that overlaps no section
is counted under a null section.

Defined cases: null or empty text has one empty section where sections are lines, and no tokens;
sections past the text's end, empty ones, null ones and those with a null begin or end have no tokens
and no characters; null sections: all tokens under the null section; sections are taken in order of
their begin, and of two that overlap the one that begins first (of equal begins, the shorter, then the
earlier in the list) keeps the shared part; a null doc_id is kept; repeated rows are counted each; an
empty table gives no rows.
"""

from __future__ import annotations

import base64

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .encode import in_slices

_encodings: dict[tuple[str, str], tuple] = {}


def _encoding(path: str, pattern: str):
    """The tiktoken encoding and the byte length of each id; one per worker."""
    if (path, pattern) not in _encodings:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for piece, i in ranks.items():
            sizes[i] = len(piece)
        _encodings[path, pattern] = tiktoken.Encoding("scoreweave", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes
    return _encodings[path, pattern]


def allot(token_ends: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token (-1: none), and whether it overlaps two or more; places in bytes."""
    a, b = np.concatenate([[0], token_ends[:-1]]), token_ends
    low, high = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left") - 1
    out, crossing = np.where(low <= high, low, -1), low < high
    for t in np.flatnonzero(crossing).tolist():
        s = np.arange(low[t], high[t] + 1)
        held = np.minimum(ends[s], b[t]) - np.maximum(begins[s], a[t])
        out[t] = s[held.argmax()]
        crossing[t] = (held > 0).sum() > 1
    return out, crossing


def in_order(sections: list[dict | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each section without what an earlier one holds, and the sections by place."""
    begin, end, low = np.zeros(len(sections), np.int64), np.zeros(len(sections), np.int64), 0
    whole = [i for i, s in enumerate(sections) if s and s["begin"] is not None and s["end"] is not None]
    by_place = sorted(whole, key=lambda i: (sections[i]["begin"], sections[i]["end"], i))
    for i in by_place:
        begin[i] = max(sections[i]["begin"], low)
        end[i] = low = max(sections[i]["end"], int(begin[i]))
    return begin, end, np.array(by_place, np.int64)


def token_counts(docs: DataFrame, path: str, pattern: str, sections_col: str | None = None) -> DataFrame:
    """doc_id, section, n_chars, n_tokens, n_crossing: tokens allotted to each section, and how many of them cross a boundary.

    sections_col: array<struct<name, begin, end>> in characters; none: the sections are the text's
    lines, each with the line break that ends it, named by number from 0.
    """
    sections = F.col(sections_col) if sections_col else F.lit(None).cast("array<struct<name: string, begin: bigint, end: bigint>>")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), sections.alias("sections"))

    def run(batches):
        import pyarrow as pa

        encoding, sizes = _encoding(path, pattern)
        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                cols = [[] for _ in range(5)]
                given = batch.column("sections").to_pylist() if sections_col else [None] * batch.num_rows
                for doc, text, own in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), given, strict=True):
                    raw = np.frombuffer(text.encode(), np.uint8)
                    token_ends = np.cumsum(sizes[encoding.encode_to_numpy(text)])
                    head = np.flatnonzero((raw & 0xC0) != 0x80)  # byte where each character begins
                    if sections_col:
                        own = own or []
                        begin, end, by_place = in_order(own)
                        names, chars = [s and s["name"] for s in own], np.minimum(end, len(head)) - np.minimum(begin, len(head))
                        place = np.append(head, len(raw))
                        begin, end = place[np.minimum(begin, len(head))], place[np.minimum(end, len(head))]
                    else:
                        cut = np.flatnonzero(raw == 10) + 1
                        begin, end = np.concatenate([[0], cut]), np.append(cut, len(raw))
                        by_place = np.arange(len(begin))
                        names, chars = list(map(str, range(len(begin)))), np.diff(np.searchsorted(head, np.append(begin, len(raw))))
                    solid = by_place[end[by_place] > begin[by_place]]  # empty sections hold nothing
                    section, crossing = allot(token_ends, begin[solid], end[solid])
                    n, crossed = np.zeros(len(names) + 1, np.int64), np.zeros(len(names) + 1, np.int64)
                    target = np.append(solid, len(names))[section]  # -1: the last place
                    np.add.at(n, target, 1)
                    np.add.at(crossed, target, crossing)
                    k = len(names) + bool(n[-1])
                    for c, v in zip(cols, ([doc] * k, [*names, None][:k], [*chars.tolist(), 0][:k], n[:k].tolist(), crossed[:k].tolist()), strict=True):
                        c += v
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                    ["doc_id", "section", "n_chars", "n_tokens", "n_crossing"])

    return plain.mapInArrow(run, "doc_id long, section string, n_chars long, n_tokens long, n_crossing long")
