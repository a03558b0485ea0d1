"""Operator 8, substring deduplication of words: de Bruijn compaction.

Windows of ``length`` words (k-mers) are the edges of a graph whose nodes are their k - 1 common words.
1. Edges that two documents hold are found by anchor (see ``repeats``). Each edge gets its source
   coordinate: the smallest document that holds it and the first place there. Inside a bucket, edges that
   follow each other in a document and in the source are one fragment of an unbranched path; where another
   source takes over, the path branches.
2. Fragments that end at the node where another begins, in the document and in the source alike, compact to
   maximal paths: one join finds the fragments that nothing precedes, one those that nothing follows, and the
   k-th head of a path's line belongs to the k-th tail.
3. Source coordinates verify: the path's words are read from the source document, and a later document loses
   them only if their digest is that of its own words.

An edge is compared by 128 bits of hash, so that a wrong source, which would leave a repeat in place, is not to be expected
at any size; nothing is removed that the words themselves don't confirm.

Defined results: a null text has no words; documents of fewer than ``length`` words are kept whole; copies of a
longer text are removed whole except in the smallest doc_id; rows that repeat a doc_id and its text each get that
document's result, rows that repeat it with another text are documents of their own, in the order of their digests; a row with null doc_id is kept whole and removes nothing elsewhere; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.llm import exchange as X
from ringside.llm import repeats as R
from ringside.llm.arrays import lean, SPACE, changes, spread, trimmed, unpacked, word_spans
from ringside.llm.rows import named_again, pack_rows, told_apart
from ringside.llm.session import partitions, written

#: Words of an anchor.
ANCHOR_WORDS = 5
#: Paths that one portion of a source's readers asks for.
ASKS = 256
FRAGMENT = "doc long, start long, n long, src long, src_start long"


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """Words with one space between."""
    if not len(starts):
        return b""
    length = ends - starts + 1
    out = data[np.minimum(spread(starts, length), len(data) - 1)]
    out[np.cumsum(length) - 1] = 0x20
    return out[:-1].tobytes()


def _fragments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, packed in X.by_bucket(batches):
        runs = R.unpack_runs(packed, lambda n: n * R.WINDOW_BYTES)
        docs, start, count, own = runs.docs, runs.start, runs.count, runs.first
        edge, rest = runs.data.view("<u8").reshape(-1, 2).T
        holder, place = np.repeat(docs[own], count[own]), spread(start[own], count[own])
        order = np.lexsort((place, holder, rest, edge))
        first = changes(edge[order], rest[order])
        length = np.diff(np.append(first, len(edge)))
        src, src_place = np.empty_like(holder), np.empty_like(place)
        src[order] = np.repeat(holder[order][first], length)
        src_place[order] = np.repeat(place[order][first], length)
        where = (np.cumsum(count[own]) - count[own])[runs.which]
        for some in R.portions(count):
            at = spread(where[some], count[some])
            run, holder, place = np.repeat(np.arange(len(docs[some])), count[some]), np.repeat(docs[some], count[some]), spread(start[some], count[some])
            source, source_place = src[at], src_place[at]
            flags = holder > source
            new = changes(run, flags, source, source_place - place)
            n = np.diff(np.append(new, len(run)))
            n, new = n[flags[new]], new[flags[new]]
            if len(new):
                yield pa.record_batch([pa.array(x) for x in (holder[new], place[new], n, source[new], source_place[new])], ["doc", "start", "n", "src", "src_start"])
    yield from trimmed(())


def compacted(fragments: DataFrame) -> DataFrame:
    """Maximal unbranched paths of the fragments: doc, start, n (edges), src, src_start."""
    after = fragments.select("doc", "src", (F.col("start") + F.col("n")).alias("start"), (F.col("src_start") + F.col("n")).alias("src_start"))
    node = ["doc", "src", "start", "src_start"]
    line = Window.partitionBy("doc", "src", "diagonal").orderBy("start")
    on_line = lambda df: df.withColumn("diagonal", F.col("start") - F.col("src_start")).withColumn("k", F.row_number().over(line))
    heads = on_line(fragments.select(*node).join(after, node, "left_anti"))
    tails = on_line(after.join(fragments.select(*node), node, "left_anti")).withColumnRenamed("start", "end").drop("src_start")
    return heads.join(tails, ["doc", "src", "diagonal", "k"]).select("doc", "start", (F.col("end") - F.col("start")).alias("n"), "src", "src_start")


def _read_sources(length: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(0))
            out = []
            for i, asks in enumerate(batch.column(1).to_pylist()):
                text = data[offsets[i] : offsets[i + 1]]
                starts, ends, _ = word_spans(text, np.array([0, len(text)]), SPACE)
                for ask in asks:
                    at = slice(ask["src_start"], ask["src_start"] + ask["n"] + length - 1)
                    out.append((ask["doc"], ask["start"], ask["n"], hashlib.md5(joined_words(text, starts[at], ends[at]), usedforsecurity=False).digest()))
            if out:
                doc, start, n, digest = zip(*out, strict=True)
                yield pa.record_batch([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary())], ["doc", "start", "n", "digest"])

    return run


def _cut(length: int, as_is: bool, carried: list[str]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = unpacked(batch.column(1))
            copies = batch.column(2).to_pylist()
            found = batch.column(3).to_pylist()
            sizes, removed, kept, spans = [], [], [], []
            for i, (copy, paths) in enumerate(zip(copies, found, strict=True)):
                text = data[offsets[i] : offsets[i + 1]]
                starts, ends, _ = word_spans(text, np.array([0, len(text)]), SPACE)
                out = np.zeros(len(starts), bool)
                if copy and len(starts) >= length:
                    out[:] = True
                for path in paths or ():
                    at = slice(path["start"], path["start"] + path["n"] + length - 1)
                    if hashlib.md5(joined_words(text, starts[at], ends[at]), usedforsecurity=False).digest() == path["digest"]:
                        out[at] = True
                edge = np.flatnonzero(np.diff(np.concatenate(([False], out, [False])).astype(np.int8)))
                sizes.append(len(starts))
                removed.append(int(out.sum()))
                kept.append(joined_words(text, starts[~out], ends[~out]) if removed[-1] or not as_is else text.tobytes())
                spans.append([{"start": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                    *(batch.column(4 + i) for i in range(len(carried))),
                ],
                ["doc_id", "n_words", "n_removed", "spans", "kept", *carried],
            )

    return run


def remove_repeated_words(docs: DataFrame, length: int = 13, as_is: bool = False, carry: tuple[str, ...] = (), doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed, spans (removed, in words) and kept (remaining words, one space between) of every row.

    With ``as_is``, texts that lose nothing are kept as they are. Columns to ``carry`` along follow (of a doc_id's rows,
    the values of one, chosen by a hash of them).
    """
    extra = [F.col(c).alias(f"carried_{i}") for i, c in enumerate(carry)]
    docs, ids = told_apart(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("body"), *extra), "doc", "body")
    carried = [f"carried_{i}" for i in range(len(carry))]
    texts, facts, runs, bits = R.window_runs(docs.where("doc is not null"), R.Windows(length, max(1, min(ANCHOR_WORDS, length)), words=True))
    paths = written(compacted(written(X.dealt(runs).mapInArrow(lean(_fragments), FRAGMENT), "fragments")), "paths")
    # A source's text goes once to every portion of those that ask for it.
    busy = paths.groupBy(F.col("src").alias("asked")).agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("portions"))
    busy = busy.select(F.greatest("asked", "asked").alias("asked"), "portions")  # as in ``exchange.classes``
    salt = F.pmod(F.xxhash64("doc"), F.col("portions"))
    # Dealt anew by portion, so that Spark may split the join's partition of a source that very many documents repeat.
    salted = paths.join(busy, F.col("src") == F.col("asked")).select("doc", "start", "n", "src", "src_start", salt.alias("salt"))
    salted = salted.repartition(partitions(docs.sparkSession), "src", "salt")
    asks = salted.groupBy("src", "salt").agg(F.collect_list(F.struct("doc", "start", "n", "src_start")).alias("asks"))
    # A source row that repeats gives the same digests again, and they are taken once.
    read = texts.join(asks, F.col("doc") == F.col("src")).select("body", "asks").mapInArrow(lean(_read_sources(length)), "doc long, start long, n long, digest binary")
    found = read.groupBy("doc").agg(F.collect_set(F.struct("start", "n", "digest")).alias("paths"))
    notes = facts.join(found, "doc", "left")
    if carried:
        notes = notes.join(docs.where("doc is not null").groupBy("doc").agg(F.min_by(F.struct(*carried), F.xxhash64(F.to_json(F.struct(*carried)))).alias("carried")), "doc")
    notes = notes.select(F.col("doc").alias("note_doc"), (F.col("rep") < F.col("doc")).alias("copy"), "paths", *(f"carried.{c}" for c in carried))
    noted = texts.join(notes, F.col("doc") == F.col("note_doc")).select("doc", "body", "copy", "paths", *carried)
    nobody = docs.where("doc is null")
    nameless = pack_rows(nobody, "body").select("doc", "body", F.lit(False).alias("copy"), F.lit(None).cast(found.schema["paths"].dataType).alias("paths"), *carried)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carried)
    out = noted.union(nameless).mapInArrow(lean(_cut(length, as_is, carried)), f"doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept string{kinds}")
    return named_again(out, ids, "doc_id").withColumnsRenamed(dict(zip(carried, carry, strict=True)))
