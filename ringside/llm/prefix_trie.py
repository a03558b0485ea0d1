"""Operator 13, a trie of conversations' prefixes: sorted turn arrays and a sweep over their common prefixes.

A turn is an element of fixed width, the SHA-256 of its role and text and its number of words, and a conversation the
array of its elements as one binary value. Conversations are dealt by ranges of (array, conv_id) and sorted, so that a
node's members are neighbours, and elements in common with the row before (the LCP) say which nodes a row is in. Each
task sweeps over its range with a stack of open nodes: a row closes those deeper than the LCP, which are whole then and
add themselves to their parents, and opens its own.

Nodes on the path of a range's first row may have begun in an earlier range, and those still open after its last row
may go on in a later one. They leave the sweep as parts; one task stitches the parts of all ranges in order with a stack
of its own. It gets one row per range and depth, however many rows a range has, and ids of conversations that end in such a
node as packed text. Nodes that closed below an open one learn its smallest member from a join with the stitched ones.

Defined results: a null role or text is empty, rows with a null conv_id take no part; turns stand in order, null first, and
those that tie in the order of their digests; rows that repeat count as turns of their own; the remainder of a negative
conv_id is negative or 0, as in SQL; an empty table has no node, not even a root; further columns are ignored. Turns are told
apart by their SHA-256. One conversation's elements (36 bytes a turn) are one value; a range's ids of equal
conversations (8 bytes each) and a subtree's nodes inside a range are held in its task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean
from ringside.llm.session import partitions, small_batches, written

WORD = r"[^\\x20\\x09-\\x0D]+"
#: Conversations of one family, and the most turns that one takes from the family's first.
FAMILY, HEADS = 20, 4
#: Bytes of an element; the last four are the number of words.
ELEMENT = 36
#: Closed nodes that a task holds before it sends them on, and bytes of packed ids.
HELD, CHUNK = 8192, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

#: What the sweep returns. kind 0: a closed node, with its parent's conv_id, or (in ``side`` and ``depth`` - 1) the open node
#: that is its parent. Kinds 1 to 3: a node that was open on the left only, on both sides, on the right only. Kind 4: ids.
CLOSED, LEFT, BOTH, RIGHT, IDS = range(5)
SWEPT = "kind int, part int, seq long, side int, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string, data binary"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
#: A stitched node (part is null), or the smallest member of a part's open node.
STITCHED = f"part int, side int, {NODE}"


class Node:
    """An open node: sums over the members and closed children met so far."""

    __slots__ = ("children", "conv", "element", "ends", "hasher", "leaves", "n", "open_left", "saved")

    def __init__(self, element: bytes, open_left: bool = False) -> None:
        self.element, self.open_left = element, open_left
        self.conv: int | None = None
        self.n = self.children = self.leaves = self.saved = 0
        self.ends: str | None = None
        self.hasher = None

    def met(self, conv: int | None, n: int) -> None:
        if conv is not None:
            self.n += n
            self.conv = conv if self.conv is None else min(self.conv, conv)

    def close(self) -> None:
        """All members are known: sums of the subtree."""
        self.leaves = self.leaves or 1
        self.saved += (self.n - 1) * int.from_bytes(self.element[-4:], "big")

    def adopt(self, child: Node) -> None:
        """A closed child's sums."""
        self.met(child.conv, child.n)
        self.children += 1
        self.leaves += child.leaves
        self.saved += child.saved


def joined(ids: list[int]) -> bytes:
    return ",".join(map(str, ids)).encode()


def common(a: bytes, b: bytes) -> int:
    """How many leading elements two arrays share."""
    if b.startswith(a):
        return len(a) // ELEMENT
    most = min(len(a), len(b)) // ELEMENT
    k = 0
    while k < most and a[k * ELEMENT : (k + 1) * ELEMENT] == b[k * ELEMENT : (k + 1) * ELEMENT]:
        k += 1
    return k


class Sweep:
    """One range's rows in order. Yields rows of ``SWEPT`` but for kind's part and seq."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.first: list[Node] = []
        self.pending: list[tuple[Node, int, Node]] = []
        self.group: list[int] = []
        self.first_ids: list[int] = []

    def _end_group(self) -> None:
        top = self.stack[-1]
        if top.open_left:
            self.first_ids = self.group
        elif self.group:
            top.ends = hashlib.sha256(joined(self.group)).hexdigest()
        self.group = []

    def _close_to(self, depth: int) -> None:
        """Closes what is deeper; a node that may have begun before this range only leaves the stack."""
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            if not node.open_left:
                node.close()
                parent = self.stack[-1]
                parent.adopt(node)
                self.pending.append((node, len(self.stack), parent))

    def _flushed(self, right: set[int] = frozenset()) -> Iterator[tuple]:
        for node, depth, parent in self.pending:
            open_side = LEFT if parent.open_left else RIGHT if id(parent) in right else None
            above = None if open_side is not None else parent.conv
            yield CLOSED, open_side, depth, node.conv, above, node.n, node.children, node.leaves, node.saved, node.ends, None
        self.pending = []

    def rows(self, ordered: Iterable[tuple[bytes, int]]) -> Iterator[tuple]:
        before: bytes | None = None
        for array, conv in ordered:
            if array != before:
                if before is None:
                    shared = -1
                else:
                    self._end_group()
                    shared = common(before, array)
                    self._close_to(shared)
                    if len(self.pending) >= HELD and self.stack[-1].open_left:
                        yield from self._flushed()
                new = [Node(array[(d - 1) * ELEMENT : d * ELEMENT] if d else b"", before is None) for d in range(shared + 1, len(array) // ELEMENT + 1)]
                self.stack += new
                if before is None:
                    self.first = new
                before = array
            self.stack[-1].met(conv, 1)
            self.group.append(conv)
        if before is not None:
            yield from self._ended()

    def _ended(self) -> Iterator[tuple]:
        top, last = self.stack[-1], self.group
        if top.open_left:
            self.first_ids, last = self.group, []
        yield from self._flushed({id(x) for x in self.stack})
        still = {id(x) for x in self.stack}

        def part(kind: int, depth: int, x: Node) -> tuple:
            return kind, None, depth, x.conv, None, x.n, x.children, x.leaves, x.saved, x.ends, x.element

        def ids(depth: int, own: list[int]) -> Iterator[tuple]:
            for i in range(0, len(own), CHUNK // 16):
                yield IDS, None, depth, None, None, None, None, None, None, None, joined(own[i : i + CHUNK // 16])

        for depth, x in enumerate(self.first):
            yield part(BOTH if id(x) in still else LEFT, depth, x)
        yield from ids(len(self.first) - 1, self.first_ids)
        for depth, x in enumerate(self.stack):
            if not x.open_left:
                yield part(RIGHT, depth, x)
        yield from ids(len(self.stack) - 1, last)


class Stitch:
    """The open nodes of all ranges, in order, with one stack."""

    def __init__(self) -> None:
        self.stack: list[Node] = []
        self.nodes: list[tuple[Node, int, Node | None]] = []
        self.asked: list[tuple[int, int, int, Node]] = []

    def _close_to(self, depth: int) -> None:
        while len(self.stack) > depth + 1:
            node = self.stack.pop()
            node.close()
            parent = self.stack[-1] if self.stack else None
            if parent is not None:
                parent.adopt(node)
            self.nodes.append((node, len(self.stack), parent))

    def rows(self, parts: Iterable[tuple]) -> Iterator[tuple]:
        """kind, part, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens, ends, data in order -> ``STITCHED``."""
        now, both = None, -1
        for kind, part, depth, conv, n, children, leaves, saved, ends, data in parts:
            if part != now:
                # What the range before knew to be whole on its right.
                if now is not None:
                    self._close_to(both)
                now, both, same = part, -1, True
            if kind == IDS:
                node = self.stack[depth]
                if node.hasher is None:
                    node.hasher = hashlib.sha256(data)
                else:
                    node.hasher.update(b"," + data)
                continue
            if kind == RIGHT:
                self._close_to(depth - 1)
                self.stack.append(Node(data))
                both = depth
            else:
                same = same and depth < len(self.stack) and self.stack[depth].element == data
                if not same:
                    self._close_to(depth - 1)
                    self.stack.append(Node(data))
                both = depth if kind == BOTH else both
            node = self.stack[depth]
            node.met(conv, n)
            node.children += children
            node.leaves += leaves
            node.saved += saved
            node.ends = ends or node.ends
            self.asked.append((part, RIGHT if kind == RIGHT else LEFT, depth, node))
        self._close_to(-1)
        for node, depth, parent in self.nodes:
            ends = node.ends or (node.hasher.hexdigest() if node.hasher else NOTHING)
            yield None, None, node.conv, depth, parent.conv if parent else None, node.n, node.children, node.leaves, node.saved, ends
        for part, side, depth, node in self.asked:
            yield part, side, node.conv, depth, None, None, None, None, None, None


KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batched(rows: Iterable[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    fields = [x.split() for x in schema.split(", ")]
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, KINDS[k]) for c, (_, k) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == 1024:
            yield batch()
            held = []
    if held:
        yield batch()


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _swept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part = TaskContext.get().partitionId()
    yield from _batched(((kind, part, seq, *rest) for seq, (kind, *rest) in enumerate(Sweep().rows(_rows(batches)))), SWEPT)


def _stitched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take = itemgetter(0, 1, 4, 5, *range(7, 13))
    yield from _batched(Stitch().rows(map(take, _rows(batches))), STITCHED)


def taken_turns(conv: Column) -> Column:
    """How many first turns a conversation takes from its family's first one."""
    return F.pmod(F.crc32(conv.cast("string")), F.lit(HEADS)).cast("int")


def turn_arrays(turns: DataFrame) -> DataFrame:
    """conv_id and array (its elements in order, one binary value) of every rebuilt conversation."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.unhex(F.lpad(F.hex(F.regexp_count(text, F.lit(WORD.replace("\\\\", "\\")))), 8, "0"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.concat(digest, words).alias("element"))
    # As structs, a null turn stands before all others.
    own = written(rows.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "element"))), lambda x: x["element"]).alias("elements")), "turns")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("elements", 1, HEADS - 1).alias("heads"))
    met = own.withColumn("of", F.col("conv_id") - F.col("conv_id") % FAMILY).join(heads, F.col("of") == F.col("family"), "left")
    h = taken_turns(F.col("conv_id"))
    empty = F.array().cast("array<binary>")
    first = F.when(h > 0, F.slice(F.coalesce("heads", empty), F.lit(1), F.greatest(h, F.lit(1)))).otherwise(empty)
    rest = F.slice("elements", h + 1, F.greatest(F.size("elements"), F.lit(1)))
    return met.select("conv_id", F.array_join(F.transform(F.concat(first, rest), F.hex), "").alias("hex")).select("conv_id", F.unhex("hex").alias("array"))


def prefix_trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie of rebuilt conversations (conv_id, turn, role, text)."""
    spark = turns.sparkSession
    small_batches(spark)
    arrays = written(turn_arrays(turns), "arrays")
    ranges = arrays.select("array", "conv_id").repartitionByRange(partitions(spark), "array", "conv_id").sortWithinPartitions("array", "conv_id")
    swept = written(ranges.mapInArrow(lean(_swept), SWEPT), "swept")
    parts = swept.where(F.col("kind") != CLOSED).repartition(1).sortWithinPartitions("part", "seq")
    stitched = written(parts.mapInArrow(lean(_stitched), STITCHED), "stitched")
    names = [x.split()[0] for x in NODE.split(", ")]
    closed = swept.where(F.col("kind") == CLOSED).withColumn("ends_sha256", F.coalesce("ends", F.lit(NOTHING)))
    inner = closed.where("side is null").select(*names)
    known = stitched.where("part is not null").select(F.col("part").alias("of_part"), F.col("side").alias("of_side"), F.col("depth").alias("of_depth"), F.col("conv_id").alias("above"))
    same = (F.col("part") == F.col("of_part")) & (F.col("side") == F.col("of_side")) & (F.col("depth") - 1 == F.col("of_depth"))
    below = closed.where("side is not null").join(known, same).withColumn("parent_conv_id", F.col("above")).select(*names)
    return stitched.where("part is null").select(*names).union(inner).union(below)
