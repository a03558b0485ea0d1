"""Which keys of a document occur in other documents too: two packed shuffles.

Every document has a list of 64-bit keys (shingles, anchors of windows). Map tasks pack the keys of
many documents into one row per hash bucket, as byte planes of a few bytes a key. Buckets of one hash
range meet in one task, which finds the keys that two or more documents hold; only those go back, in a
second packed shuffle by document. A key costs about seven bytes of shuffle, whatever its frequency;
a key that most documents hold is one bucket's long run, at eight bytes an entry, never a joined pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean, U64, changes, cut_binary, from_planes, mix64, planes, trimmed
from ringside.llm.session import partitions

PACKED = "bucket int, kind int, docs binary, keys binary, extra binary"
KEYS, FACTS = 0, 1


def rows_of(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Packed rows as record batches of a bounded size."""
    held, size = [], 0

    def batch() -> pa.RecordBatch:
        bucket, kind, *blobs = zip(*held, strict=True)
        return pa.record_batch([pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), *(pa.array(b, pa.binary()) for b in blobs)], ["bucket", "kind", "docs", "keys", "extra"])

    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row[2:])
        if size > 1 << 22 or len(held) >= 1024:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()
    yield from trimmed(())


def split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket that has entries, with their places in the order they came."""
    order = np.argsort(bucket.astype(np.uint32), kind="stable")
    bounds = np.append(changes(bucket[order]), len(order)).tolist()
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        yield int(bucket[order[begin]]), order[begin:end]


def doc_bucket(docs: np.ndarray, bits: int) -> np.ndarray:
    return mix64(docs.view(U64)) >> U64(64 - bits)


def pack_keys(docs: np.ndarray, keys: np.ndarray, bits: int, width: int) -> Iterator[tuple]:
    """Rows for the first shuffle. Of a key's hash the first ``bits`` choose the bucket and ``8 * width`` more are kept."""
    bucket = keys >> U64(64 - bits)
    low = (keys >> U64(64 - bits - 8 * width)) & U64((1 << (8 * width)) - 1)
    for b, at in split(bucket):
        yield b, KEYS, planes(docs[at], 8), planes(low[at], width), b""


def pack_facts(docs: np.ndarray, sigs: list[bytes], sizes: np.ndarray, bits: int) -> Iterator[tuple]:
    """What is known of each document (a 16-byte signature and a size) goes along to where its keys come back."""
    table = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(-1, 16)
    for b, at in split(doc_bucket(docs, bits)):
        yield b, FACTS, planes(docs[at], 8), table[at].tobytes(), planes(sizes[at], 8)


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """The packed rows of one bucket after another, from a partition sorted by bucket."""
    current, rows = None, []
    for batch in batches:
        for bucket, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != current and rows:
                yield current, rows
                rows = []
            current = bucket
            rows.append(tuple(row))
    if rows:
        yield current, rows


def _shared(bits: int, width: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for bucket, packed in by_bucket(batches):
                docs, keys = [], []
                for kind, d, k, extra in packed:
                    if kind == FACTS:
                        yield bucket, kind, d, k, extra
                    else:
                        docs.append(from_planes(d, 8).view(np.int64))
                        keys.append(from_planes(k, width))
                if not docs:
                    continue
                docs, keys = np.concatenate(docs), np.concatenate(keys)
                order = np.argsort(keys, kind="stable")
                docs, keys = docs[order], keys[order]
                first = changes(keys)
                several = np.minimum.reduceat(docs, first) != np.maximum.reduceat(docs, first)
                length = np.diff(np.append(first, len(keys)))
                kept = np.repeat(several, length)
                docs, keys = docs[kept], keys[kept] | (U64(bucket) << U64(8 * width))
                count = np.repeat(np.minimum(length[several], 0xFFFFFFFF), length[several])
                for b, at in split(doc_bucket(docs, bits)):
                    at = at[np.argsort(docs[at], kind="stable")]
                    yield b, KEYS, planes(docs[at], 8), planes(keys[at], 8), planes(count[at], 4)

        yield from rows_of(rows())

    return run


def _gather() -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, packed in by_bucket(batches):
            facts = [(from_planes(d, 8).view(np.int64), np.frombuffer(k, np.uint8).reshape(-1, 16), from_planes(x, 8)) for kind, d, k, x in packed if kind == FACTS]
            owner, sigs, sizes = (np.concatenate(x) for x in zip(*facts, strict=True))
            order = np.argsort(owner, kind="stable")
            order = order[changes(owner[order])]
            owner, sigs, sizes = owner[order], sigs[order], sizes[order]
            back = [(from_planes(d, 8).view(np.int64), from_planes(k, 8), from_planes(x, 4)) for kind, d, k, x in packed if kind == KEYS]
            docs, keys, counts = (np.concatenate(x) for x in zip(*back, strict=True)) if back else (np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, U64))
            order = np.lexsort((keys, docs))
            order = order[changes(docs[order], keys[order])]
            docs, keys, counts = docs[order], keys[order], counts[order].astype("<u4")
            bounds = np.append(np.searchsorted(docs, owner), len(docs))
            step = 2048
            for i in range(0, len(owner), step):
                at = bounds[i : i + step + 1]
                low, high = at[0], at[-1]
                yield pa.record_batch(
                    [
                        pa.array(owner[i : i + step]),
                        pa.array([s.tobytes() for s in sigs[i : i + step]], pa.binary()),
                        pa.array(sizes[i : i + step].astype(np.int64)),
                        pa.array(np.diff(at).astype(np.int64)),
                        cut_binary(keys[low:high].view(np.uint8), (at - low) * 8),
                        cut_binary(counts[low:high].view(np.uint8), (at - low) * 4),
                    ],
                    ["doc", "sig", "size", "n_shared", "keys", "counts"],
                )

    return run


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows with every bucket whole and in one partition."""
    return packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")


def shared_keys(packed: DataFrame, bits: int, width: int) -> DataFrame:
    """doc, sig, size, n_shared, keys (64-bit, sorted) and counts (32-bit) of every document that sent facts.

    ``keys`` are those that another document sent too; counts say how many entries each has.
    """
    found = dealt(packed).mapInArrow(lean(_shared(bits, width)), PACKED)
    return dealt(found).mapInArrow(lean(_gather()), "doc long, sig binary, size long, n_shared long, keys binary, counts binary")


def classes(table: DataFrame) -> DataFrame:
    """sig, rep, n: the smallest document of every signature that several documents share, and their number.

    The signature is computed anew, so that a join on it gets shuffles of its own on both sides: only then can Spark
    split the partition of a signature that very many documents have.
    """
    grouped = table.where("sig is not null").groupBy("sig").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("n"))
    return grouped.where("n > 1").select(F.substring("sig", 1, 16).alias("sig"), "rep", "n")
