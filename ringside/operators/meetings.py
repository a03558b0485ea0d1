"""Who meets whom, directly or by others: groups of athletes whose bouts don't touch each other's."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.sources.scratch import written

#: Links that one task joins, in about 200 bytes each.
FEW = 1 << 20


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task as a forest: a row for each athlete at most, with the smallest one that is linked to it."""
    parent: dict[int, int] = {}
    ids = roots = np.zeros(0, np.int64)
    late = 0

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    def table() -> tuple[np.ndarray, np.ndarray]:
        names = np.array(sorted(parent), np.int64)
        return names, np.array([root(x) for x in names.tolist()], np.int64)

    def known(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(ids, x), len(ids) - 1)
        return ids[at] == x, roots[at]

    for batch in batches:
        a, b = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        if len(ids):
            # Links inside a tree, most of them soon, say nothing new.
            (has_a, root_a), (has_b, root_b) = known(a), known(b)
            new = ~(has_a & has_b & (root_a == root_b))
            a, b = a[new], b[new]
        if not len(a):
            continue
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            if (low := min(p := root(x), q := root(y))) != (high := max(p, q)):
                parent[high] = low
        late += len(a)
        # The table takes as long as its athletes are many, so it waits for a share of them; the trees themselves are up to date.
        if 4 * late >= len(parent):
            (ids, roots), late = table(), 0
    ids, roots = table()
    yield pa.record_batch([pa.array(ids), pa.array(roots)], ["a", "b"])


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select("b", "a")).toDF("node", "next")
    least = both.groupBy("node").agg(F.min("next").alias("low")).select("node", F.least("node", "low").alias("low"))
    return both.join(least, "node").where("next > node").select(F.col("next").alias("a"), F.col("low").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("low"))
    linked = links.join(least, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return linked.union(least.toDF("a", "b")).where("a <> b")


def groups(bouts: DataFrame) -> DataFrame:
    """athlete_id, group: the smallest athlete whom bouts connect them with, for everyone with a bout.

    Tasks reduce their bouts to forests; what is left, a few rows an athlete, is joined in one task if it is at most ``FEW``
    rows, else by alternating large and small stars, whose rounds grow with the logarithm of the athletes.
    """
    links = written(bouts.select("a_id", "b_id").mapInArrow(_forest, "a long, b long").distinct(), "links")
    if links.count() <= FEW:
        return links.coalesce(1).mapInArrow(_forest, "athlete_id long, group long")
    stars, seen = links.where("a <> b"), None
    while True:
        stars = written(_small_star(_large_star(stars)).distinct(), "stars")
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen = now
    # Whoever starts a group has no row in the stars.
    return links.select(F.col("a").alias("athlete_id")).distinct().join(stars.toDF("athlete_id", "low"), "athlete_id", "left").select("athlete_id", F.coalesce("low", "athlete_id").alias("group"))
