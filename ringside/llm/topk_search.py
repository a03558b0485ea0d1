"""Operator 3, exact top-k search by inner product: norm-bucketed retrieval.

1. Vectors are grouped into buckets of similar length over the whole table (``BUCKET_RATIO`` from shortest to longest);
   a bucket of many vectors is cut into cells of bounded size.
2. Every query gets a lower bound of its k-th best score: its k-th best among the longest vectors, a set of bounded size
   that goes to all tasks.
3. A query is only sent to buckets that its bound leaves: those with |q| * longest >= bound. Vectors are sent once to each
   group of ``QUERY_GROUP`` queries.
4. In a cell the bound asks for a local cosine of t = bound / (|q| * longest). A small t prunes by length alone; a larger t
   prunes by coordinates, since on the query's strongest coordinates such a candidate must lie in a known interval. What
   remains is verified by its full product. Comparisons leave a margin for rounding, so that nothing that ties is lost.

Products are exact: in float64 where no partial sum can reach 2**53, else in integers of any size. A component or score
beyond 64 bits becomes the nearest 64-bit number and ranks as such.

Defined results: vectors that are null, or hold null or non-finite components, and rows with null vec_id, take no part;
rows that repeat a vec_id count once, with the smallest vector; a query only meets vectors of its own dimension, empty
ones score 0; ties go to the smaller vec_id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.llm.arrays import lean
from ringside.llm.session import partitions, small_batches, written

QUERY_GROUP = 16_384
CANDIDATE_GROUP = 8192
#: Shortest to longest in one bucket, and the bucket of vectors without a length.
BUCKET_RATIO, LAST_BUCKET = 0.9, 1 << 20
#: Longest vectors, and numbers in them, that give the first lower bounds.
PROBES, PROBE_NUMBERS = 1024, 1 << 20
#: From this local cosine threshold on, coordinates prune better than length.
COORDINATE_FROM = 0.35
FOCUS = 3
MARGIN = 1e-9
RESULT = "query_id long, vec_id long, score long"
LOWEST, HIGHEST = -(2**63), 2**63 - 1


class Cell:
    """Some vectors, the longest first."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        real = vectors.astype(np.float64)
        length = np.sqrt((real * real).sum(axis=1))
        order = np.lexsort((ids, -length))
        self.ids, self.vectors, self.real, self.length = ids[order], vectors[order], real[order], length[order]
        self.unit = self.real / np.maximum(self.length, 1e-300)[:, None]
        self.largest = np.abs(self.real).max(axis=1, initial=0)

    def products(self, q: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Exact inner products with the vectors at some places."""
        real = q.astype(np.float64)
        small = self.largest[at] * np.abs(real).max(initial=0) * max(1, len(q)) < 2**53
        out = np.zeros(len(at), np.int64)
        out[small] = (self.real[at[small]] @ real).astype(np.int64)
        if not small.all():
            exact = self.vectors[at[~small]].astype(object) @ q.astype(object)
            out[~small] = [min(max(int(x), LOWEST), HIGHEST) for x in exact]
        return out

    def candidates(self, q: np.ndarray, least: int | None) -> np.ndarray:
        """Places of the vectors whose product with q may reach ``least``."""
        every = np.arange(len(self.ids))
        if least is None or not len(every):
            return every
        unit = q.astype(np.float64)
        size = float(np.sqrt((unit * unit).sum()))
        unit = unit / max(size, 1e-300)
        reach = size * self.length[0]
        if least > reach * (1 + MARGIN):
            return every[:0]
        t = least / reach if reach else -1.0
        if t < COORDINATE_FROM:
            return every[: int(np.searchsorted(-self.length, -least / size * (1 - MARGIN), "right"))] if size and least > 0 else every
        t = min(1.0, t * (1 - MARGIN))
        kept = np.ones(len(every), bool)
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            # Angles: a candidate within arccos(t) of q is that near to q's angle with the axis.
            half = np.sqrt((1 - t * t) * max(0.0, 1 - unit[f] * unit[f])) + 2 * MARGIN
            if unit[f] < t:
                kept &= self.unit[:, f] <= unit[f] * t + half
            if -unit[f] < t:
                kept &= self.unit[:, f] >= unit[f] * t - half
        return every[kept]

    def search(self, query: int, q: np.ndarray, least: int | None, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k highest scores of at least ``least`` among other vectors, ties to smaller ids."""
        at = self.candidates(q, least)
        at = at[self.ids[at] != query]
        scores, ids = self.products(q, at), self.ids[at]
        if len(scores) > k:
            bound = np.partition(scores, len(scores) - k)[len(scores) - k]
            least = int(bound) if least is None else max(least, int(bound))
        if least is not None:
            kept = scores >= least
            ids, scores = ids[kept], scores[kept]
        order = np.lexsort((ids, -scores.astype(object) if (scores == LOWEST).any() else -scores))[:k]
        return ids[order], scores[order]


def _bounds(probes: dict[int, tuple[list, list]], k: int) -> Callable:
    """dim, norm, vec_id, v -> the same and ``least``: the k-th best score among the probes, null of fewer than k."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = {d: Cell(np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), d)) for d, (i, v) in probes.items()}
        for batch in batches:
            dims, values = batch.column(0).to_numpy(), batch.column(3).flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum(dims)))
            least: list[int | None] = []
            for i, (d, own) in enumerate(zip(dims.tolist(), batch.column(2).to_pylist(), strict=True)):
                scores = cells[d].search(own, values[starts[i] : starts[i + 1]], None, k)[1] if d in cells else ()
                least.append(int(scores[-1]) if len(scores) == k else None)
            yield pa.record_batch([*batch.columns, pa.array(least, pa.int64())], [*batch.schema.names, "least"])

    return run


def _cells(k: int) -> Callable:
    """Rows sorted by cell (dim, bucket, cell, query group), its candidates before its queries."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, ids, vectors, cell = None, [], [], None
        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            asked, own, least = (batch.column(i).to_pylist() for i in (4, 5, 7))
            values = batch.column(6).flatten().to_numpy()
            starts = np.concatenate(([0], np.cumsum([x[0] for x in keys])))
            out: list[tuple] = []
            for i, key in enumerate(keys):
                if key != current:
                    current, ids, vectors, cell = key, [], [], None
                v = values[starts[i] : starts[i + 1]]
                if not asked[i]:
                    ids.append(own[i])
                    vectors.append(v)
                elif ids:
                    if cell is None:
                        cell = Cell(np.array(ids, np.int64), np.array(vectors, np.int64).reshape(len(ids), key[0]))
                    near, score = cell.search(own[i], v, least[i], k)
                    out += [(own[i], a, b) for a, b in zip(near.tolist(), score.tolist(), strict=True)]
            if out:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])

    return run


def quantised(vectors: DataFrame, vec_id: str, embedding: str, factor: int) -> DataFrame:
    """vec_id, v: floor(factor * x) of every component, for the vectors that take part."""
    x = F.transform(F.col(embedding), lambda e: e.cast("double"))
    known = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where("vec_id is not null and x is not null")
    whole = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    beyond = lambda e: F.when(e >= float(HIGHEST), F.lit(HIGHEST)).when(e <= float(LOWEST), F.lit(LOWEST)).otherwise(F.floor(F.when(F.abs(e) < float(HIGHEST), e)))
    return known.where(whole).select("vec_id", F.transform("x", lambda e: beyond(e * factor)).alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, factor: int = 256, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k highest inner products among all other vectors.

    ``is_query`` is a condition on vec_id. Components are floor(factor * x).
    """
    spark = vectors.sparkSession
    small_batches(spark)
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    rows = quantised(vectors, vec_id, embedding, factor).select(F.size("v").alias("dim"), F.sqrt(square).alias("norm"), "vec_id", "v")
    bucket = F.when(F.col("norm") > 0, F.floor(F.ln("norm") / float(np.log(BUCKET_RATIO)))).otherwise(LAST_BUCKET).cast("int")
    rows = written(rows.withColumn("bucket", bucket), "vectors")
    buckets = rows.groupBy("dim", "bucket").agg(F.ceil(F.count(F.lit(1)) / CANDIDATE_GROUP).cast("int").alias("cells"), F.max("norm").alias("longest"))
    buckets = written(buckets, "buckets")
    queries, widest = rows.agg(F.count_if(is_query), F.coalesce(F.max("dim"), F.lit(1))).first()
    groups = max(1, -(-queries // QUERY_GROUP))

    probes: dict[int, tuple[list, list]] = {}
    for r in rows.orderBy(F.desc("norm"), "vec_id").limit(max(k + 1, min(PROBES, PROBE_NUMBERS // max(1, widest)))).collect():
        ids, own = probes.setdefault(r["dim"], ([], []))
        ids.append(r["vec_id"])
        own.append(r["v"])
    asking = rows.where(is_query).select("dim", "norm", "vec_id", "v").mapInArrow(lean(_bounds(probes, k)), "dim int, norm double, vec_id long, v array<long>, least long")

    group = lambda m: F.pmod(F.xxhash64("vec_id"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), m - 1))
    of_dim = buckets.groupBy("dim").agg(F.collect_list(F.struct("bucket", "cells", "longest")).alias("buckets"))
    left = F.filter("buckets", lambda b: F.col("least").isNull() | (F.col("norm") * b["longest"] * (1 + MARGIN) >= F.col("least")))
    sent = asking.join(of_dim, "dim").withColumn("b", F.explode(left))
    keys = ["dim", "bucket", "cell", "queries"]
    asked = sent.select("dim", F.col("b.bucket").alias("bucket"), every(F.col("b.cells")).alias("cell"), group(groups).alias("queries"), F.lit(True).alias("asked"), "vec_id", "v", "least")
    own_cell = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("cells")).cast("int")
    offered = rows.join(buckets, ["dim", "bucket"]).select("dim", "bucket", own_cell.alias("cell"), every(F.lit(groups)).alias("queries"), F.lit(False).alias("asked"), "vec_id", "v", F.lit(None).cast("long").alias("least"))
    cells = offered.union(asked).repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "asked")
    found = cells.mapInArrow(lean(_cells(k)), RESULT)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
