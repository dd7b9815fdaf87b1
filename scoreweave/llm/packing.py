"""Best-fit packing by sums of squares.

A document becomes token pieces; each piece goes where the sum over residual gaps of the squared
number of open bins with that gap becomes smallest. Pieces are dealt evenly into shards of a fixed
expected size, and every shard is packed on its own, so no task grows with the corpus; each shard
leaves at most a few bins open, a share that falls with the shard size.

Defined cases: null or empty text is one piece holding the end id alone; a null doc_id is packed
like any other; repeated rows are packed once each; an empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .encode import encoder, in_slices

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: only documents over the capacity are cut, into pieces of the capacity."""

    def cut(batches):
        import pyarrow as pa

        step, end = 4 * capacity, np.uint32(end_id).astype("<u4").tobytes()
        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                ids, at = encoder(tokenizer).encode(batch.column("text"))
                raw, rows = memoryview(ids.astype("<u4").tobytes()), []
                for doc, a, b in zip(batch.column("doc_id").to_pylist(), (at[:-1] * 4).tolist(), (at[1:] * 4).tolist(), strict=True):
                    own = bytes(raw[a:b]) + end
                    rows += [(doc, i // step, i // 4, (min(len(own), i + step) - i) // 4, zlib.crc32(own[i : i + step])) for i in range(0, len(own), step)]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return id_and_text(docs).mapInArrow(cut, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item, items taken from long to short.

    Of the open bins, and a new one, an item takes the one that leaves the smallest sum of squared
    counts; ties go to the smallest gap, and to an open bin before a new one.
    """
    count = np.zeros(capacity + 1, np.int64)
    bins_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable"):
        s = int(lengths[i])
        held = count[s:]
        delta = 2 * (count[: capacity + 1 - s] - held + 1)
        delta[0] = 1 - 2 * held[0]  # a full bin has no gap and counts no more
        delta[held == 0] = np.iinfo(np.int64).max
        best = int(delta.argmin())
        if delta[best] <= (2 * count[capacity - s] + 1 if s < capacity else 0):
            gap = s + best
            b = bins_at[gap].pop()
            count[gap] -= 1
        else:
            gap, b, opened = capacity, opened, opened + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            bins_at[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = 2048, shard_pieces: int = 8192) -> DataFrame:
    """pieces (with a length of 1 to capacity) plus sequence_id and offset, gapless from 0 in each sequence."""
    shards = max(1, -(-pieces.count() // shard_pieces))
    dealt = pieces.withColumn("_shard", F.monotonically_increasing_id() % shards)

    def place(key, t):
        import pyarrow as pa

        bins, offsets = sum_of_squares(t.column("length").to_numpy(), capacity)
        return t.drop_columns(["_shard"]).append_column("sequence_id", pa.array(bins + (key[0].as_py() << 32))).append_column("offset", pa.array(offsets))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_shard").applyInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """docs packed into sequences of at most capacity tokens; the pieces are written once and counted from the file."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity)
