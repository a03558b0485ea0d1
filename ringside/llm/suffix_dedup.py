"""Operator 5, suffix-array deduplication of bytes: depth-limited radix sort.

Suffixes are ordered only through their first ``length`` bytes, by passes over digits of eight bytes from
the most significant one; groups that stay equal through the last pass are exactly the repeated windows.
The first pass is Spark's: suffixes are dealt by the anchor of their window (see ``repeats``), so that
equal windows meet in one bucket. Later passes run in the bucket, on the groups that are not settled.

Defined results: a null text counts as empty; texts shorter than ``length`` bytes are kept whole; copies of
a text of at least ``length`` bytes are removed whole except in the smallest doc_id; rows that repeat a doc_id and
its text each get that document's result, rows that repeat it with another text are documents of their own, in the
order of their digests; a row with null doc_id is returned unchanged and
removes nothing elsewhere; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import exchange as X
from ringside.llm import repeats as R
from ringside.llm.arrays import lean, U64, changes, planes, spread, unpacked
from ringside.llm.rows import named_again, told_apart

#: Grams of this share of a window are anchors.
ANCHOR_SHARE = 0.52


def digits(data: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from some places on, as numbers whose order is theirs."""
    out = np.zeros(len(at), U64)
    for j in range(width):
        out <<= U64(8)
        out |= data[at + j]
    return out


def radix_groups(data: np.ndarray, suffix: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, first): suffixes whose first ``depth`` bytes occur again, group by group, and where groups begin.

    One pass for each eight bytes; after a pass, suffixes that are alone in their group are settled and leave.
    """
    order = np.arange(len(suffix))
    first = np.zeros(1 if len(suffix) else 0, np.int64)
    for done in range(0, depth, 8):
        width = min(8, depth - done)
        key = digits(data, suffix[order] + done, width)
        length = np.diff(np.append(first, len(order)))
        uneven = np.minimum.reduceat(key, first) != np.maximum.reduceat(key, first) if len(first) else np.zeros(0, bool)
        group = np.repeat(np.arange(len(first)), length)
        todo = np.flatnonzero(uneven[group]) if len(first) else np.zeros(0, np.int64)
        if len(todo):
            by = todo[np.lexsort((key[todo], group[todo]))]
            order[todo], key[todo] = order[by], key[by]
        first = changes(group, key)
        length = np.diff(np.append(first, len(order)))
        kept = np.repeat(length > 1, length)
        order = order[kept]
        length = length[length > 1]
        first = np.cumsum(length) - length
    return order, first


def _judge(length: int, bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, packed in X.by_bucket(batches):
                runs = R.unpack_runs(packed, lambda n: n + length - 1)
                docs, start, count, own = runs.docs, runs.start, runs.count, runs.first
                suffix = spread(runs.begin, count[own])
                least = np.repeat(docs[own], count[own])
                order, first = radix_groups(runs.data, suffix, length)
                if len(order):
                    least[order] = np.repeat(np.minimum.reduceat(least[order], first), np.diff(np.append(first, len(order))))
                place = (np.cumsum(count[own]) - count[own])[runs.which]
                for some in R.portions(count):
                    holder = np.repeat(docs[some], count[some])
                    flags = holder > least[spread(place[some], count[some])]
                    at, n = R.flagged_intervals(flags, np.repeat(np.arange(len(docs[some])), count[some]))
                    if not len(at):
                        continue
                    begin = spread(start[some], count[some])[at]
                    found = holder[at]
                    for b, i in X.split(X.doc_bucket(found, bits)):
                        yield b, X.KEYS, planes(found[i], 8), planes(begin[i], 4), planes(begin[i] + n[i] + length - 1, 4)

        yield from X.rows_of(rows())

    return run


def _cut(length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(1))
            copies = batch.column(2).to_pylist()
            found = batch.column(3).to_pylist()
            kept, spans = [], []
            for i, (copy, intervals) in enumerate(zip(copies, found, strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                if copy and len(text) >= length:
                    cut = [(0, len(text))]
                    text = text[:0]
                elif intervals:
                    out = R.covered(len(text), intervals)
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                    cut = list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))
                    text = text[~out]
                else:
                    cut = []
                kept.append(text.tobytes())
                spans.append([{"start": a, "end": b} for a, b in cut])
            yield pa.record_batch(
                [batch.column(0), pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(kept, pa.binary())],
                ["doc_id", "n_bytes", "spans", "kept"],
            )

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = 50, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (removed, in bytes) and kept (the remaining bytes) of every row of ``docs``."""
    docs, ids = told_apart(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body")), "doc", "body")
    kind = R.Windows(length, max(1, round(length * ANCHOR_SHARE)), words=False)
    texts, facts, runs, bits = R.window_runs(docs.where("doc is not null"), kind)
    intervals = X.dealt(X.dealt(runs).mapInArrow(lean(_judge(length, bits)), X.PACKED)).mapInArrow(lean(R.gather_intervals), "doc long, intervals binary")
    notes = facts.join(intervals, "doc", "left").select(F.col("doc").alias("note_doc"), (F.col("rep") < F.col("doc")).alias("copy"), "intervals")
    noted = texts.join(notes, F.col("doc") == F.col("note_doc")).select("doc", "body", "copy", "intervals")
    nameless = R.bodies(docs.where("doc is null")).select("doc", "body", F.lit(False).alias("copy"), F.lit(None).cast("binary").alias("intervals"))
    out = noted.union(nameless).mapInArrow(lean(_cut(length)), "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")
    return named_again(out, ids, "doc_id")
