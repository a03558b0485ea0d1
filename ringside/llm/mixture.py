"""Operator 10, mixing sources to target weights: fixed blocks, multinomial shards, index permutations.

Size is the number of words. Each source's words, its documents one after another, are packed into blocks of
``block`` words. Its target is its weight's share of all words, at most ``most`` times its own size; what it cannot
take is shared again by weight, which is the water level L with target = min(most * size, L * weight).

A source needs so many slots of one block as fill its target: whole epochs (each a pass over all its blocks) and a last one
in part. For every output shard, in turn, it is drawn from a multinomial distribution how many of its slots come from each
source, and how many of those from whole epochs; the weights are what the sources still have to give, so that the totals
hold: first over ranges of shards, then inside each range. In the last epoch a shard also skips a drawn number of places, so
that the draws decide which places of the epoch are taken at all. A slot's place goes through its epoch's pseudorandom
permutation of the source's blocks (a Feistel network that walks until it meets an existing one) to a block index. Slots and
blocks of documents meet in a join by block index; what a document gives is summed from those slots. The last slot of a
source holds only as many words as are missing, so that every target is met to the word.

Defined results: null and wordless texts have size 0 and are never taken; null is a source of its own, the last; a source
without words has target 0; an empty table gives an empty result; further columns are ignored. Rows that repeat an id
and a size lie side by side in their source and each get the same whole number of words, so that their source may fall
short by less than a word a row. All draws depend only on the seed and the data's sizes and ids, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.llm.arrays import U64, lean, mix64
from ringside.llm.session import partitions, written

WORD = r"[^\\x20\\x09-\\x0D]+"
BLOCK = 64
SEED = 20
#: Words of an output shard at most, and shards of a table at least (where it has so many slots).
SHARD_WORDS, SHARDS = 1 << 24, 64
#: Documents of a chunk whose sizes are summed in order.
CHUNK_DOCS = 4096
#: Slots that a task makes at a time.
PORTION = 1 << 18
#: Rounds of the permutation.
ROUNDS = 4
RANGES = "range long, shards long, all_shards long, all_slots long, rank int, source_size long, target double, whole long, part long, skip long, whole_before long, part_before long, skip_before long"
SHARDED = "shard long, rank int, source_size long, target double, whole long, part long, whole_before long, part_before long, place long"
SLOTS = "shard long, slot long, rank int, epoch int, index long, words int"


@dataclass(frozen=True)
class Mix:
    """documents: row of each with size, source_size and target; units: where each document's words begin in its source;
    slots: shard, slot, rank (of the source), epoch, index (of the block), words; taken: words by document row."""

    documents: DataFrame
    units: DataFrame
    slots: DataFrame
    taken: DataFrame


def sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    size = F.coalesce(F.expr(f"regexp_count(`{text}`, '{WORD}')"), F.lit(0)).cast("long")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"))


def targets(sources: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """source, source_size, ... -> the same with rank, weight and target. One row per source."""
    everything = Window.partitionBy(F.lit(0))
    ranked = sources.withColumn("rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * most
    # Sources by the level at which they are full; below level L, full ones give their cap and the others L * weight.
    by_level = everything.orderBy("full", "rank")
    levels = (
        ranked.withColumn("weight", weight)
        .withColumn("full", cap / F.col("weight"))
        .withColumn("capped", F.sum(cap).over(by_level) - cap)
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(by_level) + F.col("weight"))
        .withColumn("level", (F.sum("source_size").over(everything) - F.col("capped")) / F.col("open"))
    )
    whole = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = F.first(F.when(F.col("level") <= F.col("full"), F.col("level")), ignorenulls=True).over(whole)
    levels = levels.withColumn("total", F.sum("source_size").over(everything))
    return levels.withColumn("target", F.least(cap.cast("double"), level * F.col("weight"))).drop("full", "capped", "open", "level")


class Permutation:
    """A pseudorandom permutation of 0 .. n - 1: a balanced Feistel network on the next power of four, walked until inside."""

    def __init__(self, n: int, *keys: int) -> None:
        self.n = n
        self.half = U64(max(1, ((n - 1).bit_length() + 1) // 2))
        self.mask = (U64(1) << self.half) - U64(1)
        key = np.zeros(1, U64)
        for k in keys:
            key = mix64(key ^ U64(k & (2**64 - 1)))
        self.keys = [mix64(key + U64(i + 1)) for i in range(ROUNDS)]

    def _walked(self, x: np.ndarray, once: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        x = once(x.astype(U64))
        while len(out := np.flatnonzero(x >= U64(self.n))):
            x[out] = once(x[out])
        return x.astype(np.int64)

    def _forth(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys:
            left, right = right, left ^ (mix64(right ^ key) & self.mask)
        return left << self.half | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in reversed(self.keys):
            left, right = right ^ (mix64(left ^ key) & self.mask), left
        return left << self.half | right

    def indices(self, places: np.ndarray) -> np.ndarray:
        return self._walked(places, self._forth)

    def places(self, indices: np.ndarray) -> np.ndarray:
        return self._walked(indices, self._back)


@dataclass(frozen=True)
class Need:
    """What a source needs: blocks, whole epochs, and of the last epoch so many slots of so many places, the last of them cut."""

    blocks: int
    epochs: int
    part: int
    places: int
    last: int


def needed(size: int, target: int, block: int) -> Need:
    """The last epoch is over the full blocks, unless it needs the last, shorter one too."""
    blocks = -(-size // block)
    epochs, rest = divmod(target, size)
    if rest <= (blocks - 1) * block:
        part = -(-rest // block)
        return Need(blocks, epochs, part, blocks - 1 if rest else 0, rest - (part - 1) * block)
    return Need(blocks, epochs, blocks, blocks, rest - (blocks - 1) * block)


def generator(*keys: int) -> np.random.Generator:
    return np.random.default_rng([k & (2**64 - 1) for k in keys])


def drawn(n: int, left: np.ndarray, random: np.random.Generator) -> np.ndarray:
    """n slots over sources by what they have left: multinomial draws, and again for what a source can't give."""
    out = np.zeros(len(left), np.int64)
    while n > 0:
        weight = (left - out).astype(np.float64)
        more = np.minimum(random.multinomial(n, weight / weight.sum()), left - out)
        out += more
        n -= int(more.sum())
    return out


def skipped(left: np.ndarray, own: int, remaining: int, random: np.random.Generator) -> np.ndarray:
    """Places that shards skip in each source's last epoch, so many shards of those that remain."""
    return left if own == remaining else random.binomial(left, own / remaining)


def bounds(shards: int, slots: int, first: int, n: int) -> tuple[int, int]:
    """The slots of n shards from the first on, all shards being of one size."""
    return first * slots // shards, (first + n) * slots // shards


def _table(batches: Iterable[pa.RecordBatch]) -> list[tuple]:
    return [row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True)]


def _batch(rows: list[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    kinds = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}
    fields = [x.split() for x in schema.split(", ")]
    for i in range(0, len(rows), 1 << 14):
        columns = zip(*rows[i : i + (1 << 14)], strict=True)
        yield pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _ranges(block: int, shard_words: int, seed: int) -> Callable:
    """All sources -> what each range of shards takes of each, and how much the ranges before it took."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sources = sorted(_table(batches))
        if not sources:
            return
        needs = [needed(size, int(target), block) for _, size, target, _ in sources]
        left = np.array([n.epochs * n.blocks for n in needs] + [n.part for n in needs])
        skip = np.array([n.places - n.part for n in needs])
        slots, k = int(left.sum()), len(needs)
        shards = max(1, min(slots, max(SHARDS, -(-sources[0][3] // shard_words))))
        width = max(1, round(shards**0.5))
        before, gone = np.zeros_like(left), np.zeros_like(skip)
        for part, first in enumerate(range(0, shards, width)):
            n, random = min(width, shards - first), generator(seed, part, 1)
            low, high = bounds(shards, slots, first, n)
            own, over = drawn(high - low, left, random), skipped(skip, n, shards - first, random)
            rows = [(part, n, shards, slots, r, size, target, *map(int, (own[i], own[k + i], over[i], before[i], before[k + i], gone[i]))) for i, (r, size, target, _) in enumerate(sources) if own[i] or own[k + i] or over[i]]
            yield from _batch(rows, RANGES)
            left, skip, before, gone = left - own, skip - over, before + own, gone + over

    return run


def _shards(seed: int) -> Callable:
    """range, ... in order -> what each shard of a range takes of each source, and at which place of the last epoch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in groupby((row for b in batches for row in _table([b])), lambda r: r[0]):
            rows = list(rows)
            _, n, shards, slots = rows[0][:4]
            width = max(1, round(shards**0.5))
            table = np.array([r[7:] for r in rows], np.int64)
            left, skip = np.concatenate((table[:, 0], table[:, 1])), table[:, 2]
            before, gone, k = np.concatenate((table[:, 3], table[:, 4])), table[:, 5], len(rows)
            for shard in range(part * width, part * width + n):
                random = generator(seed, shard, 2)
                low, high = bounds(shards, slots, shard, 1)
                own, over = drawn(high - low, left, random), skipped(skip, 1, part * width + n - shard, random)
                yield from _batch([(shard, *r[4:7], *map(int, (own[i], own[k + i], before[i], before[k + i], before[k + i] + gone[i]))) for i, r in enumerate(rows) if own[i] or own[k + i]], SHARDED)
                left, skip, before, gone = left - own, skip - over, before + own, gone + over

    return run


def _slots(block: int, seed: int) -> Callable:
    """What a shard takes of a source -> its slots, each place through the permutation of its epoch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, rank, size, target, whole, part, whole_before, part_before, place in _table([batch]):
                need = needed(size, int(target), block)
                maps: dict[tuple[int, int], Permutation] = {}
                for i in range(0, whole + part, PORTION):
                    own = np.arange(i, min(i + PORTION, whole + part))
                    late = own >= whole
                    slot = whole_before + own
                    epoch = np.where(late, need.epochs, slot // need.blocks)
                    at = np.where(late, place + own - whole, slot % need.blocks)
                    index = np.empty_like(at)
                    for e in np.unique(epoch).tolist():
                        here = epoch == e
                        key = (need.places if e == need.epochs else need.blocks, e)
                        if key not in maps:
                            maps[key] = Permutation(key[0], seed, rank, e)
                        index[here] = maps[key].indices(at[here])
                    words = np.minimum(block, size - index * block)
                    if need.part == need.blocks:
                        words[late & (index == need.blocks - 1)] = need.last
                    else:
                        words[late & (part_before + own - whole == need.part - 1)] = need.last
                    kinds = [x.split() for x in SLOTS.split(", ")]
                    values = (np.full(len(own), shard), own, np.full(len(own), rank), epoch, index, words)
                    yield pa.record_batch([pa.array(v, pa.int32() if k == "int" else pa.int64()) for v, (_, k) in zip(values, kinds, strict=True)], [n for n, _ in kinds])

    return run


def ranked_in_order(rows: DataFrame, group: list[str], key: str, width: Column, value: Column, out: str) -> DataFrame:
    """``out``: the sum of ``value`` over the group's rows with a smaller key, in two levels: ranges of keys, then rows.

    ``width`` is the length of a key range; every range holds a bounded number of rows.
    """
    rows = rows.withColumn("_range", F.floor(F.col(key) / width))
    sums = rows.groupBy(*group, "_range").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_range")
    sums = sums.withColumn("_before", F.sum("_sum").over(before) - F.col("_sum")).drop("_sum")
    inside = Window.partitionBy(*group, "_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = rows.hint("merge").join(sums.hint("merge"), [*group, "_range"])
    return joined.withColumn(out, F.col("_before") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("_range", "_before")


def on_blocks(units: DataFrame, words: Column, block: int) -> DataFrame:
    """The units once for each block that holds words of theirs, by index."""
    first, last = F.floor(F.col("begin") / block), F.floor((F.col("begin") + words - 1) / block)
    return units.withColumn("index", F.explode(F.sequence(first, last)))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Mix:
    spark = docs.sparkSession
    rows = written(sized(docs, doc_id, text, source), "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs")), weights, most)
    sources = written(sources, "sources")
    about = sources.withColumnRenamed("source", "about")
    known = rows.join(about, F.col("source").eqNullSafe(F.col("about"))).select("doc_id", "size", "rank", "source_size", "target", "docs")
    documents = known.drop("rank", "docs")

    # Where each document's words begin in its source: documents by a hash of their id, in chunks of bounded size.
    # Rows that repeat an id stand side by side as one entry of their common size.
    units = known.where("size > 0").groupBy("rank", "doc_id", "size").agg(F.count(F.lit(1)).alias("copies"), F.first("docs").alias("docs"))
    units = units.withColumn("key", F.xxhash64("doc_id", "size", F.lit(seed)).bitwiseAND(F.lit((1 << 62) - 1)))
    width = F.floor(F.lit(float(1 << 62)) / F.ceil(F.col("docs") / CHUNK_DOCS))
    words = F.col("size") * F.col("copies")
    units = ranked_in_order(units, ["rank"], "key", width, words, "begin").select("rank", "doc_id", "size", "copies", "begin")

    asked = sources.where("target >= 1").select(F.col("rank").cast("int").alias("rank"), "source_size", "target", "total")
    # One row a source meets in one task, which draws for ranges of shards; the square root of their number.
    ranges = asked.coalesce(1).mapInArrow(lean(_ranges(block, shard_words, seed)), RANGES)
    shards = ranges.repartition(partitions(spark), "range").sortWithinPartitions("range", "rank").mapInArrow(lean(_shards(seed)), SHARDED)
    slots = shards.repartition(partitions(spark), "shard", "rank").mapInArrow(lean(_slots(block, seed)), SLOTS)

    # A block is taken whole so many times, and once in part if it is the last slot's.
    used = slots.groupBy("rank", "index").agg(F.max("words").alias("long"), F.min("words").alias("short"), F.count(F.lit(1)).alias("n"))
    at = F.col("index") * block
    overlap = lambda take: F.greatest(F.lit(0), F.least(F.col("begin") + words, at + take) - F.greatest(F.col("begin"), at))
    times = F.when(F.col("short") < F.col("long"), F.col("n") - 1).otherwise(F.col("n"))
    part = F.when(F.col("short") < F.col("long"), F.col("short")).otherwise(0)
    # Exploded rows look as small to the optimizer as what they came from; none of these sides may be broadcast.
    met = on_blocks(units, words, block).hint("merge").join(used.hint("merge"), ["rank", "index"])
    taken = met.withColumn("words", times * overlap(F.col("long")) + overlap(part)).groupBy("rank", "doc_id", "size", "copies").agg(F.sum("words").alias("words"))
    taken = taken.select(F.col("rank").alias("of_rank"), F.col("doc_id").alias("of_doc"), F.col("size").alias("of_size"), "copies", "words")
    same = (F.col("of_rank") == F.col("rank")) & F.col("of_doc").eqNullSafe(F.col("doc_id")) & (F.col("of_size") == F.col("size"))
    share = F.floor(F.coalesce("words", F.lit(0)) / F.coalesce("copies", F.lit(1)))
    result = known.join(taken.hint("merge"), same, "left").select("doc_id", "size", "source_size", "target", share.cast("long").alias("taken"))
    return Mix(documents, units, slots, result)


def mixed_text(docs: DataFrame, mixed: Mix, block: int = BLOCK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """shard, slot, rank, words: the mix itself, every slot with the words of its block (one blank between).

    ``docs`` and ``mixed`` (of the same rows) with ids that don't repeat. Documents are cut where blocks end, pieces meet
    in their block, and blocks meet their slots by index; a slot's rows are bounded by its number of words.
    """
    words = F.expr(f"regexp_extract_all(`{text}`, '{WORD}', 0)")
    own = docs.select(F.col(doc_id).alias("of_doc"), words.alias("own"))
    placed = mixed.units.join(own, F.col("doc_id").eqNullSafe(F.col("of_doc")))
    begin, index = F.col("begin"), F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("begin") + F.col("size") - 1) / block))

    def cut(i: Column) -> Column:
        low = F.greatest(i * block - begin, F.lit(0))
        high = F.least((i + 1) * block - begin, F.col("size"))
        return F.struct(i.alias("index"), F.struct(begin.alias("begin"), F.slice("own", (low + 1).cast("int"), (high - low).cast("int")).alias("w")).alias("piece"))

    pieces = placed.select("rank", F.explode(F.transform(index, cut)).alias("p")).select("rank", "p.*")
    blocks = pieces.groupBy("rank", "index").agg(F.flatten(F.transform(F.array_sort(F.collect_list("piece")), lambda p: p["w"])).alias("w"))
    joined = mixed.slots.hint("merge").join(blocks.hint("merge"), ["rank", "index"])
    return joined.select("shard", "slot", "rank", F.array_join(F.slice("w", F.lit(1), F.col("words")), " ").alias("words"))
