"""Operator 11, document fingerprints: a homomorphic multiset hash of paragraphs.

A paragraph is what stands between line feeds; an empty text has none. Every paragraph has a wide vector of two parts, and
a text's fingerprint is the sum of its paragraphs' vectors, lane by lane, modulo a power of two:

* 8 lanes modulo 2^64 hold the paragraph's BLAKE2b digest. Texts of the same paragraphs in any order have equal sums;
  others differ, but for collisions of 512 bits.
* 256 lanes modulo 2^16 hold a sketch: each shingle of three words (of a paragraph of fewer words: each run of six bytes, or
  the whole of it) adds 1 or -1 to one lane, both chosen by its hash. Squared lengths of such sums estimate how many
  shingles two texts don't share, so that likeness is read from two fingerprints alone.

Sums are homomorphic: paragraphs are inserted by adding their vectors and deleted by subtracting them. The edited text's
fingerprint is made so: from the original's, only the paragraphs from the cut on are taken out and put in.

Rows stand in the order of doc_id (null first; rows that repeat a doc_id by a hash of their text, then by the text). They
are dealt by ranges of this order, and each task reads its rows in order with one row held back, so that every row meets the
next one; the last row of a range meets the first of the next range in a join of one row a range.

Defined results: null texts count as empty; two empty texts have likeness 1, an empty and another one 0; a single row is
its own next one; rows that repeat wholly follow each other; an empty table gives an empty result; further columns are
ignored. Likeness is an estimate with a standard error of about 0.03 around 0.75 and 0.06 near 0, cut to 0 to 1; a shingle
that a text holds more than 32,767 times wraps, which can lower it. Rows that repeat in doc_id and text stand in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.llm.arrays import SPACE, U64, byte_gram_hashes, gram_hashes, inside_texts, lean, slices, word_hashes, word_spans
from ringside.llm.session import partitions, small_batches, written

#: Lanes of the exact part (64 bits each) and of the sketch (16 bits each).
EXACT, LANES = 8, 256
#: Words of a shingle, and bytes of a piece of a paragraph that has fewer.
SHINGLE, PIECE = 3, 6
#: Texts whose vectors are made at a time.
MANY = 128
#: A row with its next one; a range's first row, whole; its last row, whole, whose next one is in another range.
DONE, FIRST, LAST = 0, 1, 2
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def paragraphs(text: str) -> list[str]:
    return text.split("\n") if text else []


def _shingles(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the shingles of some paragraphs, and the paragraph of each."""
    starts, ends, first = word_spans(data, bounds, SPACE)
    words = np.diff(first)
    tokens = word_hashes(data, starts, ends)
    at, own = inside_texts(first, SHINGLE, len(tokens))
    yield gram_hashes(tokens, SHINGLE)[at], own
    size = np.diff(bounds)
    few = np.flatnonzero((words < SHINGLE) & (size >= PIECE))
    if len(few):
        part = np.concatenate([data[bounds[i] : bounds[i + 1]] for i in few.tolist()])
        at, own = inside_texts(np.concatenate(([0], np.cumsum(size[few]))), PIECE, len(part))
        yield byte_gram_hashes(part, PIECE)[at], few[own]
    tiny = np.flatnonzero((words < SHINGLE) & (size < PIECE))
    yield word_hashes(data, bounds[tiny], bounds[tiny + 1]), tiny


def vectors(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """For each list of paragraphs the sum of their vectors: the exact part (64-bit) and the sketch (16-bit)."""
    raw = [p.encode() for own in texts for p in own]
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(counts)
    digests = np.frombuffer(b"".join(hashlib.blake2b(p).digest() for p in raw), "<u8").reshape(-1, EXACT)
    sums = np.zeros((len(raw) + 1, EXACT), U64)
    np.cumsum(digests, axis=0, out=sums[1:])
    exact = sums[ends] - sums[ends - counts]
    owner = np.repeat(np.arange(len(texts)), counts)
    sketch = np.zeros(len(texts) * LANES, np.float64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    bounds = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    for i, j in slices(bounds):
        for value, own in _shingles(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]):
            lane = owner[own + i] * LANES + (value >> U64(56)).astype(np.int64)
            low = int(lane.min()) if len(lane) else 0
            part = np.bincount(lane - low, weights=((value >> U64(55)) & U64(1)).astype(np.float64) * 2 - 1)
            sketch[low : low + len(part)] += part
    return exact, sketch.reshape(-1, LANES).astype(np.int64).astype(np.uint16)


def pack(exact: np.ndarray, sketch: np.ndarray) -> list[bytes]:
    """Fingerprints as bytes: all lanes, first the exact ones, lowest byte first."""
    return [a.tobytes() + b.tobytes() for a, b in zip(exact.astype("<u8"), sketch.astype("<u2"), strict=True)]


def unpack(fingerprints: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    table = np.frombuffer(b"".join(fingerprints), np.uint8).reshape(-1, 8 * EXACT + 2 * LANES)
    return np.ascontiguousarray(table[:, : 8 * EXACT]).view("<u8"), np.ascontiguousarray(table[:, 8 * EXACT :]).view("<u2")


def changed(fingerprint: bytes, inserted: list[str] = (), deleted: list[str] = ()) -> bytes:
    """The fingerprint after these paragraphs are put in and those taken out."""
    (exact,), (sketch,) = unpack([fingerprint])
    more, less = (vectors([list(x)]) for x in (inserted, deleted))
    return pack((exact + more[0][0] - less[0][0])[None], (sketch + more[1][0] - less[1][0])[None])[0]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 less the squared difference of two sketches over the sum of their squared lengths, row by row, cut to 0 to 1."""
    square = lambda v: (v.astype(np.uint16).view(np.int16).astype(np.float64) ** 2).sum(axis=1)
    apart, together = square(a - b), square(a) + square(b)
    return np.clip(1 - apart / np.maximum(together, 1), 0, 1)


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many of the next text's first ones (or all)."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compared(ids: list, texts: list[str], exact: np.ndarray, sketch: np.ndarray, following: list[str], next_sketch: np.ndarray) -> list[pa.Array]:
    """The columns of ``RESULT`` for some rows, each with its next row's text and sketch."""
    after = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    out, put = [], []
    for t, e in zip(texts, after, strict=True):
        cut = len(t) - len(t) // 4
        begin = t.rfind("\n", 0, cut) + 1
        # From the paragraph of the cut on, where one is there at all; what comes before stays.
        out.append(t[begin:].split("\n") if t else [])
        put.append(e[begin:].split("\n") if e else [])
    less, more = vectors(out), vectors(put)
    new_exact, new_sketch = exact - less[0] + more[0], sketch - less[1] + more[1]
    return [
        pa.array(ids, pa.int64()),
        pa.array(list(map(len, texts)), pa.int64()),
        pa.array([hashlib.sha256(e.encode()).hexdigest() for e in after], pa.string()),
        pa.array(pack(exact, sketch), pa.binary()),
        pa.array(pack(new_exact, new_sketch), pa.binary()),
        pa.array(likeness(sketch, new_sketch)),
        pa.array(likeness(sketch, next_sketch)),
    ]


NAMES = [x.split()[0] for x in RESULT.split(", ")]


def _in_order(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range's rows (doc_id, text) in order -> kind, range, text (only of whole rows) and results."""
    part = TaskContext.get().partitionId()

    def whole(kind: int, row: int | None, text: str, exact: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        result = [pa.array([row], pa.int64()), pa.array([len(text)], pa.int64()), pa.nulls(1, pa.string()), pa.array(pack(exact, sketch), pa.binary()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())]
        return pa.record_batch([pa.array([kind], pa.int32()), pa.array([part], pa.int32()), pa.array([text]), *result], ["kind", "part", "text", *NAMES])

    held: tuple | None = None
    for batch in batches:
        for i in range(0, batch.num_rows, MANY):
            some = batch.slice(i, MANY)
            ids, texts = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
            exact, sketch = vectors([paragraphs(t) for t in texts])
            if held is None:
                yield whole(FIRST, ids[0], texts[0], exact[:1], sketch[:1])
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
                exact, sketch = np.concatenate((held[2], exact)), np.concatenate((held[3], sketch))
            held = ids[-1], texts[-1], exact[-1:], sketch[-1:]
            if n := len(ids) - 1:
                columns = _compared(ids[:n], texts[:n], exact[:n], sketch[:n], texts[1:], sketch[1:])
                yield pa.record_batch([pa.array(np.full(n, DONE), pa.int32()), pa.array(np.full(n, part), pa.int32()), pa.nulls(n, pa.string()), *columns], ["kind", "part", "text", *NAMES])
    if held is not None:
        yield whole(LAST, *held)


def _at_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, fingerprint, next_text, next_fingerprint -> results."""
    for batch in batches:
        for i in range(0, batch.num_rows, MANY):
            ids, texts, own, following, after = (c.to_pylist() for c in batch.slice(i, MANY).columns)
            yield pa.record_batch(_compared(ids, texts, *unpack(own), following, unpack(after)[1]), NAMES)


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_chars, the digest of its edited text, both fingerprints (binary), and the likeness of its
    fingerprint to that of the edited text and to the next row's."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    mixed = F.xxhash64(F.coalesce("text", F.lit("")))
    ranges = rows.withColumn("mixed", mixed).repartitionByRange(partitions(spark), "doc_id", "mixed").sortWithinPartitions("doc_id", "mixed", "text")
    table = written(ranges.select("doc_id", "text").mapInArrow(lean(_in_order), f"kind int, part int, text string, {RESULT}"), "fingerprints")
    # One number for each range that has rows; the last one's next is the first.
    order = Window.orderBy("part")
    ends = table.where(F.col("kind") == FIRST).select("part", F.row_number().over(order).alias("number"), F.lead("part").over(order).alias("after"))
    ends = ends.withColumn("after", F.coalesce("after", F.first("part").over(order)))
    first = table.where(F.col("kind") == FIRST).select(F.col("part").alias("after"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    last = table.where(F.col("kind") == LAST).select("part", "doc_id", "text", "fingerprint")
    met = last.join(ends, "part").join(first, "after").select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint")
    return table.where(F.col("kind") == DONE).select(*NAMES).union(met.mapInArrow(lean(_at_ends), RESULT))


def _plain(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, MANY):
            some = batch.slice(i, MANY)
            made = vectors([paragraphs(t or "") for t in some.column(1).to_pylist()])
            yield pa.record_batch([some.column(0), pa.array(pack(*made), pa.binary())], ["doc_id", "fingerprint"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every row, without any shuffle."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(_plain), "doc_id long, fingerprint binary")
