"""Whole rows of a text table through a shuffle, with their texts packed on the way."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.llm.arrays import lean, packed, unpacked
from ringside.llm.session import numbered, written


def _pack(at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            column = pa.array([b if ok else None for b, ok in zip(packed(texts).to_pylist(), texts.is_valid().to_pylist(), strict=True)], pa.binary())
            yield batch.set_column(at, batch.schema.names[at], column)

    return run


def _unpack(at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(at))
            raw, bounds = data.tobytes(), offsets.tolist()
            texts = [raw[a:b] if ok else None for a, b, ok in zip(bounds[:-1], bounds[1:], batch.column(at).is_valid().to_pylist(), strict=True)]
            yield batch.set_column(at, batch.schema.names[at], pa.array(texts, pa.binary()).cast(pa.string()))

    return run


def by_place(rows: DataFrame) -> DataFrame:
    """The same columns under plain names (c0, c1, ...), for steps that can't read names with dots, or names of their own."""
    return rows.toDF(*(f"c{i}" for i in range(len(rows.columns))))


def _with(rows: DataFrame, text: str, kind: T.DataType, run: Callable) -> DataFrame:
    at = rows.columns.index(text)
    schema = T.StructType([T.StructField(f"c{i}", kind if i == at else f.dataType, True) for i, f in enumerate(rows.schema)])
    return by_place(rows).mapInArrow(lean(run(at)), schema).toDF(*rows.columns)


def pack_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    """The same rows with that column packed to binary."""
    return _with(rows, text, T.BinaryType(), _pack)


def unpack_rows(rows: DataFrame, text: str = "text") -> DataFrame:
    return _with(rows, text, T.StringType(), _unpack)


def without_ids(rows: DataFrame, gone: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``rows`` whose id is not in ``gone`` (one column), one row for each id, and all rows with a null id."""
    named = pack_rows(rows.where(F.col(row_id).isNotNull()), text)
    key = gone.toDF("id").distinct()
    kept = named.alias("rows").join(key.alias("gone"), F.col(f"rows.`{row_id}`") == F.col("gone.id"), "left_anti").dropDuplicates([row_id])
    return unpack_rows(kept, text).union(rows.where(F.col(row_id).isNull()))


def _replaced(rows: DataFrame, at: int, by: str) -> DataFrame:
    """Columns c0, c1, ... of ``rows`` with one of them replaced."""
    return rows.select(*(F.col(by) if i == at else F.col(f"c{i}") for i in range(len([c for c in rows.columns if c[0] == "c"]))))


def told_apart(rows: DataFrame, row_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """``rows`` such that no two of one id differ in text, and what their ids were (own, id), or None if they stay.

    Usually no id repeats with another text, which is looked up in a grouping of ids and hashes. Where one does, each id and
    text gets a number in the order of ids and, inside an id, of digests: such rows are documents of their own.
    """
    at, body = rows.columns.index(row_id), rows.columns.index(text)
    named = by_place(rows)
    content = F.coalesce(F.col(f"c{body}").cast("string"), F.lit(""))
    seen = named.where(F.col(f"c{at}").isNotNull()).select(F.col(f"c{at}").cast("long").alias("id"), content.alias("content"))
    if seen.groupBy("id").agg(F.min(F.xxhash64("content")).alias("a"), F.max(F.xxhash64("content")).alias("b")).where("a <> b").isEmpty():
        return rows, None
    keys = written(numbered(seen.select("id", F.sha2("content", 256).alias("digest")).distinct(), ["id", "digest"], "own"), "ids")
    met = named.join(keys, (F.col(f"c{at}").cast("long") == F.col("id")) & (F.sha2(content, 256) == F.col("digest")), "left")
    return _replaced(met, at, "own").toDF(*rows.columns), keys.select("own", "id")


def named_again(rows: DataFrame, ids: DataFrame | None, *columns: str) -> DataFrame:
    """``rows`` with the numbers of ``told_apart`` in some columns turned back to ids."""
    for c in columns if ids is not None else ():
        at = rows.columns.index(c)
        rows = _replaced(by_place(rows).join(ids, F.col(f"c{at}") == F.col("own"), "left"), at, "id").toDF(*rows.columns)
    return rows
