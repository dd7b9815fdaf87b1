"""Token-id shards as wavelet matrices: one compressed file each, with access, count and occurrence lookup.

File: magic, header length (uint32), header (JSON: bits, number of tokens and documents, zeros per
plane, sizes of the two lists), the ones before each block and the place of each block in the file
(uint32, per plane), zlib lists of document ids (int64 deltas) and document lengths (uint32), then
the blocks of the bit planes from the highest bit down, eight tokens a byte. In the plane of a bit
the tokens stand in the order that stable partitions by all higher bits leave them in. A block is
2**16 bits, deflated where that makes it smaller. Opening a file inflates nothing: a lookup inflates
the one block per plane that it reads, and the stored counts of ones answer rank; binary search in
them, select.

Texts are encoded before the shuffle, which deals the ids by ranges of doc_id whose bounds come from
a read of that column alone. An id that spans several ranges is dealt over them by its texts' hash.

Defined cases: null or empty text is the end id alone; a null doc_id sorts first; rows of one doc_id
stand in any order, repeated rows are written each; an empty table writes no file and reads back no rows.
"""

from __future__ import annotations

import json
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import id_and_text, new_path, written
from .encode import encoder, in_slices
from .words import bytes_of

MAGIC = b"WAVM2\n"
NO_ID = -(1 << 63)  # stands for a null doc_id
BLOCK = 1 << 16  # bits
OPEN_BLOCKS = 256  # inflated blocks that an opened file keeps


def _partition(tokens: np.ndarray, bits: int) -> tuple[list[np.ndarray], list[int]]:
    planes, zeros, x = [], [], tokens
    for b in range(bits - 1, -1, -1):
        one = (x & x.dtype.type(1 << b)) != 0
        planes.append(np.packbits(one))
        low = x[~one]
        zeros.append(len(low))
        x = np.concatenate([low, x[one]])
    return planes, zeros


def _blocks(plane: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Ones in each block of a plane of n bits, and the blocks as stored."""
    size, count = BLOCK // 8, -(-n // BLOCK)
    ones = np.bitwise_count(np.pad(plane, (0, count * size - len(plane)))).reshape(count, size).sum(1, dtype=np.int64)
    out = []
    for j, held in enumerate(ones.tolist()):
        raw = plane[j * size : (j + 1) * size].tobytes()
        packed = raw if 0.2 < held / (8 * len(raw)) < 0.8 else zlib.compress(raw, 1)  # even bits don't deflate
        out.append(packed if len(packed) < len(raw) else raw)
    return ones, out


def build(doc_ids: np.ndarray, lengths: np.ndarray, tokens: np.ndarray, bits: int) -> bytes:
    """The bytes of one shard's file."""
    if len(tokens) and int(tokens.max()) >> bits:
        raise ValueError(f"a token id does not fit in {bits} bits")
    planes, zeros = _partition(tokens, bits)
    with np.errstate(over="ignore"):
        deltas = np.diff(doc_ids, prepend=np.int64(0))
    lists = [zlib.compress(x.tobytes(), 1) for x in (deltas.astype("<i8"), lengths.astype("<u4"))]
    ones, blocks = zip(*(_blocks(p, len(tokens)) for p in planes), strict=True)
    before = np.stack([np.cumsum(x) - x for x in ones])
    sizes = np.array([len(b) for part in blocks for b in part], np.int64)
    places = np.append(0, np.cumsum(sizes))
    head = json.dumps({"bits": bits, "n": len(tokens), "docs": len(doc_ids), "zeros": zeros, "lists": [len(x) for x in lists]}).encode()
    return b"".join([MAGIC, struct.pack("<I", len(head)), head, before.astype("<u4").tobytes(), places.astype("<u4").tobytes(), *lists,
        *(b for part in blocks for b in part)])


class WaveletMatrix:
    """One shard's file, opened."""

    def __init__(self, raw: bytes):
        if raw[: len(MAGIC)] != MAGIC:
            raise ValueError("not a shard file")
        at = len(MAGIC) + 4
        size = struct.unpack("<I", raw[len(MAGIC) : at])[0]
        head = json.loads(raw[at : at + size])
        at += size
        self.bits, self.n, self.zeros, self.n_docs = head["bits"], head["n"], head["zeros"], head["docs"]
        self._count = -(-self.n // BLOCK)
        self._before = np.frombuffer(raw, "<u4", self.bits * self._count, at).reshape(self.bits, self._count)
        at += self._before.nbytes
        self._places = np.frombuffer(raw, "<u4", self.bits * self._count + 1, at)
        at += self._places.nbytes
        self._lists = at, at + head["lists"][0], at + sum(head["lists"])
        self._raw, self._open = raw, {}

    @property
    def doc_ids(self) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.cumsum(np.frombuffer(zlib.decompress(self._raw[self._lists[0] : self._lists[1]]), "<i8"), dtype=np.int64)

    @property
    def lengths(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self._raw[self._lists[1] : self._lists[2]]), "<u4").astype(np.int64)

    def _stored(self, level: int, block: int) -> bytes:
        """One block of a plane, inflated."""
        a, b = (self._lists[2] + int(x) for x in self._places[level * self._count + block :][:2])
        size = min(BLOCK // 8, -(-(self.n - block * BLOCK) // 8))
        return self._raw[a:b] if b - a == size else zlib.decompress(self._raw[a:b])

    def _block(self, level: int, block: int) -> np.ndarray:
        key = level * self._count + block
        if key not in self._open:
            if len(self._open) >= OPEN_BLOCKS:
                self._open.pop(next(iter(self._open)))
            self._open[key] = np.frombuffer(self._stored(level, block), np.uint8)
        return self._open[key]

    def _ones(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block, rest = divmod(i, BLOCK)
        if block == self._count:
            return self.n - self.zeros[level]
        part = self._block(level, block)[: -(-rest // 8)]
        ones = int(np.bitwise_count(part).sum(dtype=np.int64))
        if rest & 7:
            ones -= (int(part[-1]) & (0xFF >> (rest & 7))).bit_count()
        return int(self._before[level, block]) + ones

    def access(self, i: int) -> int:
        """The token at position i."""
        value = 0
        for level in range(self.bits):
            one = self._block(level, i // BLOCK)[i % BLOCK >> 3] >> (7 - (i & 7)) & 1
            value = value << 1 | int(one)
            ones = self._ones(level, i)
            i = self.zeros[level] + ones if one else i - ones
        return value

    def _interval(self, token: int, i: int) -> tuple[int, int]:
        lo, hi = 0, i
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (self.zeros[level] + a, self.zeros[level] + b) if token >> (self.bits - 1 - level) & 1 else (lo - a, hi - b)
        return lo, hi

    def rank(self, token: int, i: int) -> int:
        """How often the token stands among the first i."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._interval(token, i)
        return hi - lo

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """The position of the token's occurrence number k (from 0)."""
        if not 0 <= k < self.count(token):
            raise IndexError(k)
        at = self._interval(token, self.n)[0] + k
        for level in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - level) & 1
            want = at - self.zeros[level] if one else at
            ones = self._before[level].astype(np.int64)
            seen = ones if one else np.arange(self._count) * BLOCK - ones
            block = int(np.searchsorted(seen, want, "right")) - 1
            flags = np.unpackbits(self._block(level, block), count=min(BLOCK, self.n - block * BLOCK))
            at = block * BLOCK + int(np.flatnonzero(flags == one)[want - int(seen[block])])
        return at

    def tokens(self) -> np.ndarray:
        """All tokens: the partitions undone from the lowest plane up."""
        x = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in range(self.bits - 1, -1, -1):
            plane = np.frombuffer(b"".join(self._stored(level, j) for j in range(self._count)), np.uint8)
            one = np.unpackbits(plane, count=self.n).view(bool)
            z, y = self.zeros[level], np.empty_like(x)
            y[~one] = x[:z]
            y[one] = x[z:] | x.dtype.type(1 << (self.bits - 1 - level))
            x = y
        return x


def range_bounds(ids: DataFrame, n: int, each: int = 100) -> np.ndarray:
    """Bounds of n ranges of ids (one column, no nulls) with about as many rows: from a sample of about `each` ids a range.

    The sample sets the bounds alone; every row falls in a range.
    """
    rows = ids.count()
    drawn = ids.sample(min(1.0, each * n / rows), seed=7) if rows else ids
    some = np.sort(drawn.toArrow().column(0).to_numpy().astype(np.int64))
    return some[np.arange(1, n) * len(some) // n] if len(some) else some


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int, bits: int = 16, shard_tokens: int = 1 << 21) -> DataFrame:
    """Files of about shard_tokens tokens in ascending doc_id order; returns their index, one row a file.

    Files get their name when complete: an attempt that is lost or repeated leaves no half file,
    and only files that the written index names are read.
    """
    kind = np.dtype("<u2" if bits <= 16 else "<u4")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    did = F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")
    plain = id_and_text(docs)
    bounds = range_bounds(plain.select(did), n)

    def encode(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, "text", 2 << 20):
                tokens, at = encoder(tokenizer).encode(batch.column("text"))
                if len(tokens) and int(tokens.max()) >> bits:
                    raise ValueError(f"a token id does not fit in {bits} bits")
                tokens = np.insert(tokens.astype(kind), at[1:], end_id)
                ends = (at + np.arange(len(at))) * kind.itemsize
                ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(tokens)])
                doc = batch.column("doc_id").to_numpy()
                low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
                share = batch.column("th").to_numpy().view(np.uint64) / 2.0**64
                part = np.minimum(low + (share * (high - low + 1)).astype(np.int64), high)
                yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), batch.column("doc_id"), ids], ["part", "doc_id", "ids"])

    def run(batches):
        import uuid

        import pyarrow as pa
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(path)
        store.create_dir(base, recursive=True)
        part, held, ids, lengths, size, shard = TaskContext.get().partitionId(), [], [], [], 0, 0

        def flush():
            nonlocal held, ids, lengths, size, shard
            file = f"{part:08d}-{shard:08d}-{uuid.uuid4().hex}.wavm"
            raw = build(np.concatenate(ids), np.concatenate(lengths), np.concatenate(held), bits)
            with store.open_output_stream(f"{base}/_{file}") as out:
                out.write(raw)
            store.move(f"{base}/_{file}", f"{base}/{file}")
            row = pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "file": [file], "n_tokens": [size]})
            held, ids, lengths, size, shard = [], [], [], 0, shard + 1
            return row.cast(pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("n_tokens", pa.int64())]))

        for batch in batches:
            raw, starts = bytes_of(batch.column("ids"))
            tokens, starts, doc = np.frombuffer(raw.tobytes(), kind), starts // kind.itemsize, batch.column("doc_id").to_numpy()
            i = 0
            while i < len(doc):
                j = min(len(doc), max(i + 1, int(np.searchsorted(starts, starts[i] + shard_tokens - size))))
                held.append(tokens[starts[i] : starts[j]])
                ids.append(doc[i:j])
                lengths.append(np.diff(starts[i : j + 1]))
                size += int(starts[j] - starts[i])
                i = j
                if size >= shard_tokens:
                    yield flush()
        if ids:
            yield flush()

    keyed = plain.select(did, F.xxhash64("text").alias("th"), "text")
    dealt = keyed.mapInArrow(encode, "part int, doc_id long, ids binary").repartitionById(n, F.col("part")).sortWithinPartitions("doc_id")
    return written(dealt.select("doc_id", "ids").mapInArrow(run, "part int, shard int, file string, n_tokens long"), "shard-index")


def read_shards(spark, path: str, index: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for raw, first in zip(batch.column("content").to_pylist(), batch.column("first").to_pylist(), strict=True):
                w = WaveletMatrix(raw)
                tokens = w.tokens().astype("<u4")
                lengths, doc_ids = w.lengths, w.doc_ids
                ends = np.cumsum(lengths)
                for i in range(0, len(ends), 1024):
                    starts, n = (ends - lengths)[i : i + 1024], lengths[i : i + 1024]
                    ids = [tokens[a : a + b].tobytes() for a, b in zip(starts, n, strict=True)]
                    docs = [None if x == NO_ID else x for x in doc_ids[i : i + 1024].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(starts + first), pa.array(n),
                        pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    if index.isEmpty():  # nothing was written, so there is no folder either
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")

    # Tokens before each file: by a window within its part, and over the parts, of which there are as many as tasks.
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    within = F.coalesce(F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = index.withColumn("within", within).join(before, "part").select("file", (F.col("within") + F.col("before")).alias("first"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wavm").load(path)
    named = files.withColumn("file", F.element_at(F.split("path", "/"), -1)).join(placed, "file").select("content", "first")
    return named.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """docs written as shards and read back."""
    spark = docs.sparkSession
    path = new_path(spark, "shards")
    return read_shards(spark, path, write_shards(docs, path, tokenizer, end_id))
