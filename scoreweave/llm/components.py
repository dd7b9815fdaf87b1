"""Connected components of a large graph by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node reachable) for every node of a link between two different nodes.

    A large-star round ties the larger neighbours of each node to its smallest neighbour, a
    small-star round the smaller ones. The smallest neighbour is a map-side combined aggregate and a
    table of its own, so that the links of a node with many leaves are split over tasks in the join
    with it. Each round is written to the shared folder; the loop ends when links no longer change.
    """

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")).toDF("u", "v") if large else edges.select(F.greatest("a", "b"), F.least("a", "b")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least-neighbours")
        tied = both.join(low, "u")
        if large:
            out = tied.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = tied.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.toDF("a", "b"))
        after = written(out.where("a <> b").distinct(), "links")
        for done in (edges, low):
            drop_written(done)
        return after

    def mark(edges: DataFrame):
        return edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()

    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b").distinct(), "links")
    seen = mark(edges)
    for _ in range(most_rounds):
        edges = star(star(edges, True), False)
        before, seen = seen, mark(edges)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("a").agg(F.min("b").alias("root")).toDF("node", "root")
    return roots.union(roots.select("root", "root").distinct())
