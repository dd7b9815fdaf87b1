"""SimHash near-duplicates: fingerprints, tiles of fingerprints, exact comparison, groups.

Distinct fingerprints are laid in tiles by the population counts of their four 16-bit quarters.
Fingerprints within a radius lie in tiles whose counts differ by no more than the radius in sum, so
each tile meets only those neighbours, and a pair of tiles is compared whole with numpy's exclusive
or and bit counts. There are at most 17**4 tiles, so their counts are a small table; by them a tile's
own fingerprints and those it meets are both dealt over salts, each pair of parts a row of bounded
size. A row keeps a spanning forest of the links it finds, never all pairs of a group.

Defined cases: null, empty or wordless texts have fingerprint zero and link like any other; fewer
words than a shingle are one shingle; equal texts share a fingerprint; a null doc_id never becomes
a component's id unless all its ids are null; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, id_and_text, written
from .components import connected_components
from .encode import in_slices, texts_of

QUARTERS = 4


def fingerprint_of(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    from xxhash import xxh64_intdigest

    words = text.lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    tail = [words[i : i + n] for i in range(min(shingle, len(words)))]
    hashes = np.array([xxh64_intdigest(s, seed) for s in map(b" ".join, zip(*tail, strict=True))], ">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 4096):
        part = hashes[i : i + 4096]
        ones += np.unpackbits(part.view(np.uint8).reshape(len(part), 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(texts: DataFrame, shingle: int = 3) -> DataFrame:
    """The columns before the last, which is the text, and fp (the 64 bits as a long)."""
    *carried, text = texts.columns

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for batch in in_slices(whole, text, 2 << 20):
                fps = np.array([fingerprint_of(t, shingle) for t in texts_of(batch.column(text))], np.uint64)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*carried, "fp"])

    return texts.mapInArrow(run, ", ".join(f"{c} long" for c in (*carried, "fp")))


class Forest:
    """Keeps, of links, those that join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.kept: list[tuple[int, int]] = []

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            p, q = self.top(x), self.top(y)
            if p != q:
                self.up[max(p, q)] = min(p, q)
                self.kept.append((x, y))


def _steps(radius: int) -> list[tuple[int, ...]]:
    """Differences of four counts that sum to the radius at most."""
    every = (tuple(int(x) - radius for x in s) for s in np.ndindex(*[2 * radius + 1] * QUARTERS))
    return [s for s in every if sum(map(abs, s)) <= radius]


def _parts(counts: DataFrame, later: list[tuple[int, ...]], own: int, met: int) -> DataFrame:
    """home, n_own and n_met: into how many parts each tile's own fingerprints and those it meets are dealt."""
    side = 64 // QUARTERS + 1
    size = np.zeros([side] * QUARTERS, np.int64)
    for *at, n in counts.toLocalIterator():  # at most side**QUARTERS rows
        size[tuple(at)] = n
    padded = np.pad(size, [(side, side)] * QUARTERS)
    meets = size + sum(padded[tuple(slice(side + d, 2 * side + d) for d in s)] for s in later)
    at = np.argwhere(size > 0)
    n = np.stack([-(-size[tuple(at.T)] // own), -(-meets[tuple(at.T)] // met)], axis=1)
    rows = [(tuple(a), *b) for a, b in zip(at.tolist(), n.tolist(), strict=True)]
    return counts.sparkSession.createDataFrame(rows, f"home struct<{', '.join(f'c{i}: int' for i in range(QUARTERS))}>, n_own int, n_met int")


def links_within(fps: DataFrame, radius: int = 2, tile: int = 4096) -> DataFrame:
    """Links a, b between distinct fingerprints (column fp) that differ in at most radius bits; a spanning
    forest of each tile's links, which has the same components as all of them."""
    counts = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(0xFFFF)) for i in range(QUARTERS)]
    tiled = fps.select("fp", *(c.alias(f"c{i}") for i, c in enumerate(counts)))
    later = [s for s in _steps(radius) if s > (0,) * QUARTERS]
    parts = F.broadcast(_parts(tiled.groupBy("c0", "c1", "c2", "c3").count(), later, tile, 4 * tile))

    # A tile meets its own fingerprints and those of the later neighbours: every part of the one side, every part of the other.
    key = lambda shift: F.struct(*((F.col(f"c{i}") - d).cast("int").alias(f"c{i}") for i, d in enumerate(shift)))
    homes = F.array(*(key(s) for s in [(0,) * QUARTERS, *later]))
    part = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    owned = tiled.select(key((0,) * QUARTERS).alias("home"), "fp").join(parts, "home").select("home", part("n_own").alias("i"),
        every("n_met").alias("j"), "fp", F.lit(True).alias("own"))
    guests = tiled.select(F.explode(homes).alias("home"), "fp").join(parts, "home").select("home", every("n_own").alias("i"),
        part("n_met").alias("j"), "fp", F.lit(False).alias("own"))
    groups = owned.union(guests).groupBy("home", "i", "j").agg(F.collect_list(F.when(F.col("own"), F.col("fp"))).alias("own"),
        F.collect_list(F.when(~F.col("own"), F.col("fp"))).alias("met"))

    def compare(batches):
        import pyarrow as pa

        for batch in batches:
            kept = []
            for own, met in zip(batch.column("own"), batch.column("met"), strict=True):
                x = own.values.to_numpy().view(np.uint64)
                y = met.values.to_numpy().view(np.uint64)
                forest = Forest()
                for i in range(0, len(x), 256):
                    for j in range(0, len(y), 8192):
                        near = np.bitwise_count(x[i : i + 256, None] ^ y[None, j : j + 8192]) <= radius
                        p, q = np.nonzero(near)
                        p, q = x[i : i + 256][p], y[j : j + 8192][q]
                        forest.add(p[p != q].view(np.int64), q[p != q].view(np.int64))
                kept += forest.kept
            yield pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], ["a", "b"])

    return groups.select("own", "met").mapInArrow(compare, "a long, b long")


def _rooted(marked: DataFrame, first, radius: int) -> DataFrame:
    """fp, its root and the first of its documents, by the given aggregate; a written table."""
    firsts = written(marked.groupBy("fp").agg(first.alias("first")), "distinct-fingerprints")
    groups = connected_components(links_within(firsts.select("fp"), radius)).toDF("fp", "root")
    rooted = written(firsts.join(groups, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    drop_written(firsts)
    return rooted


def near_groups(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fp, component_id: the smallest doc_id that a chain of links reaches."""
    marked = written(fingerprints(id_and_text(docs), shingle), "fingerprints")
    rooted = _rooted(marked, F.min("doc_id"), radius)
    lowest = written(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "lowest")  # a table, so that a hot root's rows are split
    named = rooted.join(lowest, "root").select("fp", "component_id")
    return marked.join(named, "fp").select("doc_id", "fp", "component_id")


def one_per_group(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """docs with one document of each group: the one with the smallest doc_id (null: before all), then text hash."""
    text = F.coalesce(F.col("text"), F.lit(""))
    key = {"did": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "th": F.xxhash64(text)}
    marked = written(fingerprints(docs.select(*(c.alias(k) for k, c in key.items()), text.alias("text")), shingle), "fingerprints")
    stay = _rooted(marked, F.min(F.struct(*key)), radius).groupBy("root").agg(F.min("first").alias("first")).select("first.*")
    rows = docs.select(F.struct("*").alias("row"), *(c.alias(k) for k, c in key.items()))
    kept = rows.join(stay, [*key], "left_semi").dropDuplicates([*key])  # equal rows are one document
    return kept.select(*(F.col(f"row.`{c}`") for c in docs.columns))
