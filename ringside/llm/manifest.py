"""Operator 12, a Merkle manifest of a dataset: a trie of radix ranks.

A row's leaf is the SHA-256 of its fields, each framed by its length. Leaves of a language stand in the order of doc_id; a
leaf's rank is found without sorting the whole table: histograms of doc_id by its digits (of 12 bits, as many as the
ids' range needs) are summed from the longest prefix up, running sums inside each prefix are added from the top down,
and only the rows of one longest prefix, 4,096 ids, are put in order.

The digits of the rank to the base of the fanout are the leaf's path in a trie. Nodes are reduced by longest prefix: in one
round those that share all but their last ``DIGITS`` digits, 4,096 at most, meet in a task and become one node, so a
language of n leaves needs log(n) / log(4096) rounds. The languages' subroots, in the order of their names, are the leaves of
one more such trie. On the way back each prefix meets its node's path (the hashes before and after it on every level up
to the root), and the task that holds the prefix lengthens it down to the leaves: every row's proof, and the root that its
leaf folds to.

Defined results: a null field is ``-``; rows with a null doc_id come first in their language and are not tampered
with; rows that repeat a doc_id stand in the order of their leaves; a single leaf is its language's subroot, a single subroot
the root; a proof without siblings is the hash of nothing; an empty table gives an empty result; further columns are ignored.
Rows that repeat one doc_id, and those with none, are put in order in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.llm.arrays import lean
from ringside.llm.session import numbered, partitions, small_batches, written

FANOUT = 8
#: Digits of a rank that one round of the reduction takes away.
DIGITS = 4
#: Bits of a doc_id's digit.
BITS = 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
NODE = "tree long, leaves long, rank long, hash string"
PATH = "tree long, leaves long, rank long, root string, below string, before array<string>, after array<string>"
RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_hash(values: list[Column]) -> Column:
    def framed(value: Column) -> Column:
        text = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.sha2(F.concat(*map(framed, values)), 256)


def height(leaves: int) -> int:
    """Levels above a tree's leaves."""
    h = 0
    while FANOUT**h < leaves:
        h += 1
    return h


def levels(hashes: list[str], n: int) -> list[list[str]]:
    """Nodes of one prefix, and those of n levels above them."""
    out = [hashes]
    for _ in range(n):
        below = out[-1]
        out.append([sha("".join(below[i : i + FANOUT])) for i in range(0, len(below), FANOUT)])
    return out


def siblings(nodes: list[list[str]], at: int, n: int) -> tuple[list[str], list[str]]:
    """Of the node at a place of the lowest level: the hashes before and after it in its run, on each of n levels."""
    before, after = [], []
    for level in nodes[:n]:
        run = at - at % FANOUT
        before.append("".join(level[run:at]))
        after.append("".join(level[at + 1 : run + FANOUT]))
        at //= FANOUT
    return before, after


def folded(leaf: str, before: list[str], after: list[str]) -> str:
    for a, b in zip(before, after, strict=True):
        leaf = sha(a + leaf + b)
    return leaf


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batched(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield batch()
            held = []
    if held:
        yield batch()


def _taken(leaves: int, done: int) -> int:
    """Levels that a round takes away from a tree that ``done`` levels are gone from."""
    return max(0, min(DIGITS, height(leaves) - done))


def _reduce(done: int) -> Callable:
    """tree, prefix, leaves, rank, hash in order -> each prefix as one node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def nodes() -> Iterator[tuple]:
            for (tree, prefix, leaves), own in groupby(_rows(batches), lambda r: r[:3]):
                yield tree, leaves, prefix, levels([r[4] for r in own], _taken(leaves, done))[-1][0]

        yield from _batched(nodes(), NODE)

    return run


def _lengthened(done: int, emit: Callable) -> Callable:
    """Of each prefix, its node's path and then its rows, in order -> what ``emit`` makes of every row and its path."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for (_, _, leaves), own in groupby(_rows(batches), lambda r: r[:3]):
                own = list(own)
                path, own = own[0], own[1:]
                _, _, root, below, upper_before, upper_after = path[3:9]
                n = _taken(leaves, done)
                nodes = levels([r[4] for r in own], n)
                for at, row in enumerate(own):
                    before, after = siblings(nodes, at, n)
                    yield emit(row, leaves, root, below, [*before, *upper_before], [*after, *upper_after])

        yield from _batched(rows(), RESULT if emit is _judged else PATH)

    return run


def _pathed(row: tuple, leaves: int, root: str, below: str, before: list[str], after: list[str]) -> tuple:
    return row[0], leaves, row[3], root, below, before, after


def _judged(row: tuple, leaves: int, root: str, below: str, before: list[str], after: list[str]) -> tuple:
    doc_id, leaf, tampered = row[9], row[4], row[10]
    again = folded(tampered or leaf, before, after)
    return doc_id, leaf, below, root, sha("".join(a + b for a, b in zip(before, after, strict=True))), again, again == root


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """Every prefix whole and in one partition, in order."""
    return rows.repartition(partitions(rows.sparkSession), "tree", "prefix").sortWithinPartitions("tree", "prefix", *order)


def prefix_of(rank: str) -> Column:
    return F.shiftright(rank, DIGITS * (FANOUT.bit_length() - 1)).alias("prefix")


def reduced(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds' nodes, from the leaves (written already) to one node a tree; ``most``: leaves of the largest tree."""
    rounds = [nodes]
    for done in range(0, max(1, height(most)), DIGITS):
        own = rounds[-1].select("tree", prefix_of("rank"), "leaves", "rank", "hash")
        rounds.append(written(_dealt(own, ["rank"]).mapInArrow(lean(_reduce(done)), NODE), "nodes"))
    return rounds


def pathed(rounds: list[DataFrame], tops: DataFrame, final: bool = False) -> DataFrame:
    """From the top nodes' paths, those of the lowest round's nodes; in the end each leaf's proof."""
    null = F.lit(None)
    for k in reversed(range(len(rounds) - 1)):
        last = final and k == 0
        own = rounds[k]
        extra = ("doc_id", "tampered") if last else (null.cast("long").alias("doc_id"), null.cast("string").alias("tampered"))
        strings = null.cast("array<string>")
        down = own.select("tree", prefix_of("rank"), "leaves", "rank", "hash", null.cast("string").alias("root"), null.cast("string").alias("below"), strings.alias("before"), strings.alias("after"), *extra)
        up = tops.select("tree", F.col("rank").alias("prefix"), "leaves", F.lit(-1).cast("long").alias("rank"), null.cast("string").alias("hash"), "root", "below", "before", "after", null.cast("long").alias("doc_id"), null.cast("string").alias("tampered"))
        both = _dealt(up.union(down), ["rank"])
        tops = both.mapInArrow(lean(_lengthened(k * DIGITS, _judged if last else _pathed)), RESULT if last else PATH)
        if not last:
            tops = written(tops, "paths")
    return tops


def ranked(rows: DataFrame, trees: DataFrame, least: int, greatest: int) -> DataFrame:
    """tag, key, ... -> tree, leaves, rank (from 0 in each tag by key and hash), ...

    ``key`` is doc_id as an unsigned number, null first; ``least`` and ``greatest`` bound its longest prefixes.
    """
    counts = [rows.groupBy("tag", F.col("prefix").alias("p")).agg(F.count(F.lit(1)).alias("n"))]
    while least >> (BITS * (len(counts) - 1)) != greatest >> (BITS * (len(counts) - 1)):
        # A null doc_id's prefix is -1, and so are all prefixes of it.
        counts.append(counts[-1].groupBy("tag", F.shiftright("p", BITS).alias("p")).agg(F.sum("n").alias("n")))
    starts = trees.select("tag", "tree", "leaves")
    for depth, level in enumerate(reversed(counts)):
        inside = Window.partitionBy("tag", *([F.shiftright("p", BITS)] if depth else [])).orderBy("p")
        own = level.withColumn("inside", F.sum("n").over(inside) - F.col("n"))
        if depth:
            upper = starts.select(F.col("tag").alias("of"), F.col("p").alias("upper"), "tree", "leaves", "start")
            met = own.join(upper, (F.col("tag") == F.col("of")) & (F.shiftright("p", BITS) == F.col("upper")))
            starts = met.select("tag", "p", "tree", "leaves", (F.col("start") + F.col("inside")).alias("start"))
        else:
            starts = own.join(starts, "tag").select("tag", "p", "tree", "leaves", F.col("inside").alias("start"))
    met = rows.join(starts.withColumnsRenamed({"tag": "of", "p": "longest"}), (F.col("tag") == F.col("of")) & (F.col("prefix") == F.col("longest")))
    place = F.row_number().over(Window.partitionBy("tag", "prefix").orderBy(F.col("doc_id").asc_nulls_first(), "hash"))
    return met.select("tree", "leaves", (F.col("start") + place - 1).alias("rank"), "hash", "doc_id", "tampered")


def manifest(docs: DataFrame, tamper: Column | None = None, lang: str = "lang") -> DataFrame:
    """Every row's leaf, its language's subroot, the root, its proof, and the root that its leaf folds to.

    Rows for which ``tamper`` holds fold the leaf of their text in lower case (A-Z) instead of their own.
    """
    spark = docs.sparkSession
    small_batches(spark)
    value = {c: F.col(c).cast("long") if c in ("doc_id", "n_chars") else F.col(c).cast("string") for c in FIELDS}
    lower = F.translate(value["text"], "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    other = F.when(F.coalesce(F.lit(False) if tamper is None else tamper, F.lit(False)), leaf_hash([lower if c == "text" else value[c] for c in FIELDS]))
    # The sign turned, ids are in order as unsigned numbers; the longest prefix is all but the last digit.
    prefix = F.coalesce(F.shiftrightunsigned(value["doc_id"].bitwiseXOR(F.lit(-(1 << 63)).cast("long")), BITS), F.lit(-1).cast("long"))
    tag = F.coalesce(F.concat(F.lit("="), F.col(lang).cast("string")), F.lit(""))
    rows = written(docs.select(tag.alias("tag"), prefix.alias("prefix"), value["doc_id"].alias("doc_id"), leaf_hash([value[c] for c in FIELDS]).alias("hash"), other.alias("tampered")), "leaves")
    least, greatest = rows.where("prefix >= 0").agg(F.min("prefix"), F.max("prefix")).first()
    trees = written(numbered(rows.groupBy("tag").agg(F.count(F.lit(1)).alias("leaves")), "tag", "tree"), "trees")
    n, most = trees.agg(F.count(F.lit(1)), F.coalesce(F.max("leaves"), F.lit(1))).first()
    nodes = written(ranked(rows, trees, least or 0, greatest or 0), "ranked")
    rounds = reduced(nodes, most)
    # One more tree, whose leaves are the subroots.
    top = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(n).cast("long").alias("leaves"), F.col("tree").alias("rank"), "hash")
    over = reduced(top, n)
    none = F.array().cast("array<string>")
    root = over[-1].select("tree", "leaves", "rank", F.col("hash").alias("root"), F.lit("").alias("below"), none.alias("before"), none.alias("after"))
    paths = pathed(over, root).select(F.col("rank").alias("tree"), "root", "before", "after")
    subroots = rounds[-1].select(F.col("tree").alias("of"), "leaves", F.col("hash").alias("below"))
    tops = paths.join(subroots, F.col("tree") == F.col("of")).select("tree", "leaves", F.lit(0).cast("long").alias("rank"), "root", "below", "before", "after")
    return pathed(rounds, tops, final=True)
