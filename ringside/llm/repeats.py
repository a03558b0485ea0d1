"""Windows of L tokens that a document shares with an earlier one: the part common to byte and word deduplication.

1. Anchors. In every window the m-gram with the smallest hash is its anchor; equal windows have equal
   anchors, and neighbouring windows mostly the same one. The anchors of all documents go through
   ``exchange.shared_keys``, which leaves those that two documents hold. Exact copies of a text are one
   class: only its smallest document goes on.
2. Runs. Consecutive windows with one shared anchor are sent together to the anchor's bucket: all
   places of a window meet there, and nothing else is sent.
3. In its bucket every window gets the smallest document that holds it (bytes: radix passes over the
   suffixes themselves; words: window hashes), and later documents get the covered intervals back.

No step joins pairs of documents, and a text that everyone shares costs one entry per run and document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import exchange as X
from ringside.llm.arrays import (
    lean,
    SPACE,
    U64,
    byte_gram_hashes,
    changes,
    cut_binary,
    from_planes,
    gram_hashes,
    inside_texts,
    mix64,
    packed as packed_texts,
    planes,
    slices,
    sliding_min,
    spread,
    text_buffers,
    unpacked,
    word_hashes,
    word_spans,
)
from ringside.llm.session import bucket_bits, partitions, small_batches, written

#: Bytes of an anchor's hash that are sent, besides the bits that choose its bucket.
ANCHOR_BYTES = 5
#: Bytes of the hash that stands for a window of words.
WINDOW_BYTES = 16
#: Bytes of text whose keys one map task holds before it packs them.
PACK_BYTES = 8 << 20


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` tokens, tokens being bytes or words; anchors are ``gram`` tokens long."""

    length: int
    gram: int
    words: bool

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of some texts, and where each text's tokens start."""
        if not self.words:
            return data, offsets
        starts, ends, first = word_spans(data, offsets, SPACE)
        return word_hashes(data, starts, ends), first

    def grams(self, tokens: np.ndarray, k: int) -> np.ndarray:
        return gram_hashes(tokens, k) if self.words else byte_gram_hashes(tokens, k)

    def anchors(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, text and anchor of every window inside a text."""
        starts, text = inside_texts(first, self.length, len(tokens))
        if not len(starts):
            return starts, text, np.zeros(0, U64)
        lowest = sliding_min(self.grams(tokens, self.gram), self.length - self.gram + 1)
        # Minima are small numbers; mixed again, they spread evenly over the buckets.
        return starts, text, mix64(lowest[starts])


def smallest_of_copies(ids: np.ndarray, sigs: list[bytes]) -> np.ndarray:
    """True for the smallest document of each signature."""
    table = np.frombuffer(b"".join(sigs), dtype="V16")
    _, group = np.unique(table, return_inverse=True)
    order = np.lexsort((ids, group))
    kept = np.zeros(len(ids), bool)
    kept[order[changes(group[order])]] = True
    return kept


def _send_anchors(kind: Windows, bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            ids, sigs, sizes, place, keys, held, n = [], [], [], [], [], 0, 0

            def flush() -> Iterator[tuple]:
                docs = np.concatenate(ids)
                yield from X.pack_facts(docs, sigs, np.concatenate(sizes), bits)
                at, key = np.concatenate(place), np.concatenate(keys)
                kept = smallest_of_copies(docs, sigs)[at]
                yield from X.pack_keys(docs[at[kept]], key[kept], bits, ANCHOR_BYTES)

            for batch in batches:
                doc = batch.column(0).to_numpy()
                data, offsets = text_buffers(batch.column(1))
                for i, j in slices(offsets):
                    part = data[offsets[i] : offsets[j]]
                    cut = offsets[i : j + 1] - offsets[i]
                    tokens, first = kind.tokens(part, cut)
                    _, text, anchor = kind.anchors(tokens, first)
                    new = changes(text, anchor)
                    raw = part.tobytes()
                    sigs += [hashlib.md5(raw[a:b], usedforsecurity=False).digest() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    ids.append(doc[i:j])
                    sizes.append(np.diff(first))
                    place.append(text[new] + n)
                    keys.append(anchor[new])
                    n += j - i
                    held += len(part)
                    if held >= PACK_BYTES:
                        yield from flush()
                        ids, sigs, sizes, place, keys, held, n = [], [], [], [], [], 0, 0
            if ids:
                yield from flush()

        yield from X.rows_of(rows())

    return run


def _send_runs(kind: Windows, bits: int) -> Callable:
    """From doc, body, keys: the windows whose anchor is shared, as runs by the anchor's bucket."""
    shift = U64(64 - bits - 8 * ANCHOR_BYTES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size = [], 0

            def flush() -> Iterator[tuple]:
                bucket, docs, start, count, content, length = (np.concatenate(x) for x in zip(*held, strict=True))
                begin = np.cumsum(length) - length
                raw = content.tobytes()
                for b, at in X.split(bucket):
                    seen: dict[bytes, int] = {}
                    which = np.array([seen.setdefault(raw[i:j], len(seen)) for i, j in zip(begin[at].tolist(), (begin + length)[at].tolist(), strict=True)])
                    yield b, X.KEYS, planes(docs[at], 8), b"".join(seen), planes(start[at], 4) + planes(count[at], 4) + planes(which, 4)

            for batch in batches:
                doc = batch.column(0).to_numpy()
                data, offsets = unpacked(batch.column(1))
                shared = batch.column(2).to_pylist()
                for i, j in slices(offsets):
                    part = data[offsets[i] : offsets[j]]
                    wanted = np.unique(np.frombuffer(b"".join(shared[i:j]), dtype="<u8"))
                    tokens, first = kind.tokens(part, offsets[i : j + 1] - offsets[i])
                    starts, text, anchor = kind.anchors(tokens, first)
                    if not len(starts) or not len(wanted):
                        continue
                    new = changes(text, anchor)
                    count = np.diff(np.append(new, len(starts)))
                    key = anchor[new] >> shift
                    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    hit = wanted[at] == key
                    new, count = new[hit], count[hit]
                    if not len(new):
                        continue
                    if kind.words:
                        unit = np.stack((kind.grams(tokens, kind.length), kind.grams(mix64(tokens), kind.length)), axis=1)
                        content = unit[spread(starts[new], count)].reshape(-1).view(np.uint8)
                        length = count * WINDOW_BYTES
                    else:
                        length = count + kind.length - 1
                        content = part[spread(starts[new], length)]
                    held.append(((anchor[new] >> U64(64 - bits)).astype(np.int64), doc[i:j][text[new]], starts[new] - first[text[new]], count, content, length))
                    size += len(content)
                    if size >= PACK_BYTES:
                        yield from flush()
                        held, size = [], 0
            if held:
                yield from flush()

        yield from X.rows_of(rows())

    return run


def packed_bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), packed_texts(batch.column(1))], ["doc", "body"])


def bodies(docs: DataFrame) -> DataFrame:
    """doc and body, packed."""
    return docs.select("doc", "body").mapInArrow(lean(packed_bodies), "doc long, body binary")


def window_runs(docs: DataFrame, kind: Windows) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(texts, facts, runs, bits): packed texts dealt by doc; facts with one row per document, its class's smallest
    document as ``rep``; and the runs of windows that may be shared, packed by anchor bucket.

    ``docs`` has doc, never null, and body. Both uses of ``texts`` are inner joins on doc, so that Spark shuffles it once."""
    small_batches(docs.sparkSession)
    bits = bucket_bits(docs, "body")
    table = X.shared_keys(docs.select("doc", "body").mapInArrow(lean(_send_anchors(kind, bits)), X.PACKED), bits, ANCHOR_BYTES)
    table = written(table.select("doc", "sig", "size", F.when(F.length("keys") > 0, F.col("keys")).alias("keys")), "shared")
    facts = table.join(X.classes(table), "sig", "left").select("doc", F.coalesce("rep", "doc").alias("rep"), "size", "keys")
    texts = bodies(docs).repartition(partitions(docs.sparkSession), "doc")
    some = facts.where("rep = doc and keys is not null").select(F.col("doc").alias("key_doc"), "keys")
    runs = texts.join(some, F.col("doc") == F.col("key_doc")).select("doc", "body", "keys").mapInArrow(lean(_send_runs(kind, bits)), X.PACKED)
    return texts, facts.drop("keys"), runs, bits


@dataclass
class Runs:
    """Runs of one bucket: document, first window, number of windows and content number of each, and the contents.

    Runs with equal contents are sent once by a task and judged once, however many documents hold them; ``first`` is
    the first run (by document, then place) of each content, ``begin`` and ``data`` are its bytes.
    """

    docs: np.ndarray
    start: np.ndarray
    count: np.ndarray
    which: np.ndarray
    first: np.ndarray
    begin: np.ndarray
    data: np.ndarray


def unpack_runs(packed: list[tuple], size: Callable[[np.ndarray], np.ndarray]) -> Runs:
    """``size``: bytes of a content with so many windows."""
    docs, starts, counts, which, seen = [], [], [], [], {}
    for _, d, content, extra in packed:
        start, count, local = (from_planes(extra[i * len(extra) // 3 : (i + 1) * len(extra) // 3], 4).astype(np.int64) for i in range(3))
        lengths = np.zeros(int(local.max()) + 1, np.int64)
        lengths[local] = size(count)
        ends = np.cumsum(lengths)
        number = [seen.setdefault(content[a:b], len(seen)) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
        docs.append(from_planes(d, 8).view(np.int64))
        starts.append(start)
        counts.append(count)
        which.append(np.array(number, np.int64)[local])
    docs, starts, counts, which = (np.concatenate(x) for x in (docs, starts, counts, which))
    order = np.lexsort((starts, docs, which))
    first = order[changes(which[order])]
    length = np.fromiter(map(len, seen), np.int64, len(seen))
    return Runs(docs, starts, counts, which, first, np.cumsum(length) - length, np.frombuffer(b"".join(seen), np.uint8))


def portions(count: np.ndarray, limit: int = 1 << 18) -> Iterator[slice]:
    """Slices of runs with about ``limit`` windows together."""
    total = np.cumsum(count)
    first = 0
    while first < len(count):
        last = max(first + 1, int(np.searchsorted(total, (total[first - 1] if first else 0) + limit, "right")))
        yield slice(first, last)
        first = last


def flagged_intervals(flags: np.ndarray, run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First window and number of windows of every stretch of flagged windows inside one run."""
    first = changes(run, flags)
    length = np.diff(np.append(first, len(flags)))
    kept = flags[first] if len(first) else np.zeros(0, bool)
    return first[kept], length[kept]


def gather_intervals(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From packed intervals dealt by document: doc and its intervals as pairs of 32-bit numbers."""
    for _, packed in X.by_bucket(batches):
        docs = np.concatenate([from_planes(d, 8).view(np.int64) for _, d, _, _ in packed])
        start = np.concatenate([from_planes(k, 4) for _, _, k, _ in packed])
        end = np.concatenate([from_planes(x, 4) for _, _, _, x in packed])
        order = np.lexsort((end, start, docs))
        docs, pairs = docs[order], np.stack((start[order], end[order]), axis=1).astype("<u4")
        first = changes(docs)
        bounds = np.append(first, len(docs))
        for i in range(0, len(first), 4096):
            at = bounds[i : i + 4097]
            yield pa.record_batch(
                [pa.array(docs[at[:-1]]), cut_binary(pairs[at[0] : at[-1]].reshape(-1).view(np.uint8), (at - at[0]) * 8)],
                ["doc", "intervals"],
            )


def covered(n: int, intervals: bytes) -> np.ndarray:
    """True for the tokens 0 .. n - 1 inside an interval."""
    pairs = np.minimum(np.frombuffer(intervals, "<u4").reshape(-1, 2).astype(np.int64), n)
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, pairs[:, 0], 1)
    np.add.at(step, pairs[:, 1], -1)
    return np.cumsum(step[:n]) > 0
