"""Connected components of a distributed edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean
from ringside.llm.session import rewritten, written


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of one batch as stars: as many rows as it has nodes at most."""
    for batch in batches:
        parent: dict[int, int] = {}

        def root(x: int, parent: dict[int, int] = parent) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (low := min(x := root(a), y := root(b))) != (high := max(x, y)):
                parent[high] = low
        pairs = [(x, root(x)) for x in list(parent)]
        pairs = [(x, r) for x, r in pairs if x != r]
        yield pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([r for _, r in pairs], pa.int64())], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("b", "a")).toDF("node", "next")
    least = both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.join(least, "node").where("next > node").select(F.col("next").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("low"))
    linked = edges.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(least.toDF("a", "b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """a, b of undirected edges -> node, component (its smallest node), for every node with an edge.

    Each round is a few grouped minima and joins over at most the nodes' number of edges, written to the
    shared folder, and the one before is removed; rounds grow with the logarithm of the nodes. Nothing is collected but two sums a round.
    """
    a, b = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    stars = written(edges.where("a <> b").select(a, b).mapInArrow(lean(_forest), "a long, b long").distinct(), "stars")
    seen = None
    while True:
        stars = rewritten(_small_star(_large_star(stars)).distinct(), "stars", old=stars)
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).union(stars.select("b", "b").distinct())
