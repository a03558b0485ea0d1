"""Operator 4, n-gram Jaccard join: adaptive multi-match prefixes.

1. Every document becomes the set of its distinct shingles. Documents with equal sets are one class, and its
   smallest document stands for it. ``exchange.shared_keys`` returns to each document the shingles that others
   hold too, with their frequencies; documents with less than the threshold's share of those can have no link.
2. Shingles are ordered by rarity. Of x with n shingles, T = ceil(t * n) must be shared by any partner, so two
   partners share their first k common shingles inside the (n - T + k)-prefixes of both. Each document takes the
   k with the least estimated cost: the frequencies of its prefix (entries to read) and, divided by k, the most
   candidates that could reach k matches.
3. Two partners' first common shingle lies in the 1-prefixes of both. If it is rare (at most ``RARE`` entries), they meet
   there: the few documents of every rare prefix shingle are paired, matches are counted over all of a pair's rare prefix
   shingles, and pairs with fewer than min(k_x, k_y) matches (less what their common ones could add) go no further. The
   others are verified on all their shared shingles. Every entry makes less than ``RARE`` pairs, however texts are chained.
4. Pairs whose first common shingle is frequent would be too many to list. Documents connected by frequent shingles of
   their 1-prefixes form clusters; these are cut by size (partners differ by less than a third) and into tiles of bounded
   number and bytes, and each pair of tiles is one row group. Inside, pairs that share min(k_x, k_y) prefix shingles and
   no rare one are verified, and the tile returns link counts and a spanning forest: no list of pairs leaves it.
5. Links join to components, by ``components``.

Shingles are compared by 45 bits of hash or more (40 and the bucket's, which grow with the table): for two documents of
n shingles, the chance of one false match is below n * n / 2**45.

Defined results: null and wordless texts have an empty set, component = their own id and no link; a text of fewer
words than a shingle has its whole sequence as the one shingle; rows that repeat a doc_id and its text count as one
document and each get its row, rows that repeat it with another text are documents of their own; a row with null doc_id has a null component and links with nothing; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm import exchange as X
from ringside.llm.arrays import lean, LOWER, SPACE, U64, changes, cut_binary, gram_hashes, inside_texts, mix64, slices, text_buffers, word_hashes, word_spans
from ringside.llm.components import components
from ringside.llm.repeats import PACK_BYTES, smallest_of_copies
from ringside.llm.rows import named_again, told_apart
from ringside.llm.session import bucket_bits, partitions, small_batches, written

#: Bytes of a shingle's hash that are sent, besides the bits that choose its bucket.
SHINGLE_BYTES = 5
#: Documents and bytes of one tile of a candidate cluster.
TILE, TILE_BYTES = 1024, 48 << 20
#: Entries of a rare shingle, at most.
RARE = 16
#: What a candidate costs, measured in prefix entries.
VERIFY_COST = 4.0


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, SPACE)
    tokens = word_hashes(data, starts, ends)
    grams = gram_hashes(tokens, words)
    at, text = inside_texts(first, words, len(tokens))
    found = grams[at]
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = changes(found, text)
    found, text = found[new], text[new]
    bounds = np.searchsorted(text, np.arange(len(offsets)))
    sets = [found[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    count = np.diff(first)
    for i in np.flatnonzero((count > 0) & (count < words)):
        n = int(count[i])
        own = tokens[first[i] : first[i + 1]]
        sets[i] = mix64(gram_hashes(own, n) ^ U64(n))
    return sets


def _send_shingles(words: int, bits: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            ids, sigs, sets, held = [], [], [], 0

            def flush() -> Iterator[tuple]:
                docs = np.concatenate(ids)
                sizes = np.array([len(s) for s in sets])
                yield from X.pack_facts(docs, sigs, sizes, bits)
                kept = smallest_of_copies(docs, sigs)
                mine = [s for s, k in zip(sets, kept.tolist(), strict=True) if k]
                yield from X.pack_keys(np.repeat(docs[kept], sizes[kept]), np.concatenate(mine), bits, SHINGLE_BYTES)

            for batch in batches:
                doc = batch.column(0).to_numpy()
                data, offsets = text_buffers(batch.column(1))
                for i, j in slices(offsets):
                    found = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                    ids.append(doc[i:j])
                    sets += found
                    sigs += [hashlib.md5(s.tobytes(), usedforsecurity=False).digest() for s in found]
                    held += offsets[j] - offsets[i]
                    if held >= PACK_BYTES:
                        yield from flush()
                        ids, sigs, sets, held = [], [], [], 0
            if ids:
                yield from flush()

        yield from X.rows_of(rows())

    return run


def _count_only(words: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            yield pa.record_batch([pa.array([len(s) for s in shingle_sets(data, offsets, words)], pa.int64())], ["n_shingles"])

    return run


def matches_for(counts: np.ndarray, must: int) -> int:
    """k of least estimated cost for a document whose shared shingles have these frequencies, rarest first."""
    most = max(1, min(must, 32))
    k = np.arange(1, most + 1)
    total = np.cumsum(counts.astype(np.float64))
    read = total[np.minimum(len(counts) - must + k, len(counts)) - 1]
    return int(np.argmin(read + VERIFY_COST * read / k)) + 1


def _prefixes(percent: int, rare: int) -> Callable:
    """doc, size, keys, counts -> keys by rarity, k, and how many of the 1-prefix are rare; the rare ones of the k-prefix and the
    frequent ones of the 1-prefix as lists, and how many frequent ones the k-prefix has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column(1).to_numpy()
            ks, heads, ordered, lists, tails, others = [], [], [], [], [], []
            for n, keys, counts in zip(size.tolist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                keys, counts = np.frombuffer(keys, "<u8"), np.frombuffer(counts, "<u4")
                by = np.lexsort((keys, counts))
                keys, counts = keys[by], counts[by]
                must = -(-percent * n // 100)
                k = matches_for(counts, must)
                one, more, few = len(keys) - must + 1, min(len(keys), len(keys) - must + k), int(np.searchsorted(counts, rare, "right"))
                ks.append(k)
                heads.append(min(one, few))
                ordered.append(keys.tobytes())
                lists.append(keys[: min(more, few)].view(np.int64))
                tails.append(keys[few:one].view(np.int64))
                others.append(max(0, more - few))
            longs = pa.list_(pa.int64())
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(ks, pa.int32()), pa.array(heads, pa.int32()), pa.array(others, pa.int32()), pa.array(lists, longs), pa.array(tails, longs), pa.array(ordered, pa.binary())],
                ["doc", "size", "k", "head", "frequent", "rare", "tail", "keys"],
            )

    return run


def _verified(percent: int) -> Callable:
    """a, b, and size, weight and keys of both -> doc, other (a link), links; and its mirror without the link."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, other, count = [], [], []
            for a, b, n, m, v, w, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                both = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
                if 100 * both >= percent * (n + m - both):
                    doc += [a, a, b]
                    other += [b, None, None]
                    count += [0, w, v]
            yield pa.record_batch([pa.array(z, pa.int64()) for z in (doc, other, count)], ["doc", "other", "links"])

    return run


def overlaps(tokens: np.ndarray, owner: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many tokens documents share: rows are documents in ``left``, columns those in ``right``; owner[i] has tokens[i]."""
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    first = changes(tokens)
    length = np.diff(np.append(first, len(tokens)))
    kept = np.repeat(length > 1, length)
    owner, column = owner[kept], np.repeat(np.arange((length > 1).sum()), length[length > 1])
    row = np.full(max(owner.max(initial=-1), left.max(initial=-1), right.max(initial=-1)) + 1, -1)
    col = row.copy()
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    total = np.zeros((len(left), len(right)), np.float32)
    step = max(64, (1 << 22) // max(1, len(left) + len(right)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, (begin, begin + step))
        who, which = owner[low:high], column[low:high] - begin
        a = np.zeros((len(left), step), np.float32)
        b = np.zeros((len(right), step), np.float32)
        at = row[who] >= 0
        a[row[who[at]], which[at]] = 1
        at = col[who] >= 0
        b[col[who[at]], which[at]] = 1
        total += a @ b.T
    return total


def tile_links(size: np.ndarray, k: np.ndarray, keys: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int, rare: np.ndarray) -> np.ndarray:
    """Which documents of ``left`` link with which of ``right`` (a document doesn't link with itself).

    ``rare``: so many keys of a document's 1-prefix are rare. Pairs that share one of those are not judged here.
    """
    must = -(-percent * size // 100)
    length = np.array([len(x) for x in keys])
    prefix = np.minimum(length, length - must + k)
    head = overlaps(np.concatenate([x[:p] for x, p in zip(keys, prefix.tolist(), strict=True)]), np.repeat(np.arange(len(keys)), prefix), left, right)
    candidate = (head >= np.minimum(k[left][:, None], k[right][None])) & (left[:, None] != right[None])
    candidate &= (100 * size[left][:, None] >= percent * size[right][None]) & (100 * size[right][None] >= percent * size[left][:, None])
    if rare.any():
        candidate &= overlaps(np.concatenate([x[:p] for x, p in zip(keys, rare.tolist(), strict=True)]), np.repeat(np.arange(len(keys)), rare), left, right) == 0
    links = np.zeros_like(candidate)
    i, j = np.flatnonzero(candidate.any(1)), np.flatnonzero(candidate.any(0))
    if len(i):
        some = np.unique(np.concatenate((left[i], right[j])))
        both = overlaps(np.concatenate([keys[x] for x in some]), np.repeat(some, length[some]), left[i], right[j])
        union = size[left[i]][:, None] + size[right[j]][None] - both
        links[np.ix_(i, j)] = candidate[np.ix_(i, j)] & (100 * both >= percent * union)
    return links


def spanning_forest(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges that connect what the links connect."""
    by_left, by_right = {x: i for i, x in enumerate(left.tolist())}, {x: j for j, x in enumerate(right.tolist())}
    unseen = np.ones(n, bool)
    edges = []
    for begin in range(n):
        if not unseen[begin]:
            continue
        unseen[begin] = False
        todo = [begin]
        while todo:
            x = todo.pop()
            near = [right[links[by_left[x]]]] if x in by_left else []
            near += [left[links[:, by_right[x]]]] if x in by_right else []
            for y in np.concatenate(near)[unseen[np.concatenate(near)]].tolist():
                if unseen[y]:
                    unseen[y] = False
                    edges.append((x, y))
                    todo.append(y)
    return edges


def _tiles(percent: int) -> Callable:
    """Rows sorted by cluster, one, two (the tiles) -> doc, other (a spanning edge) or doc, links."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[list[tuple]]:
            held, current = [], None
            for batch in batches:
                for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if row[:3] != current and held:
                        yield held
                        held = []
                    current = row[:3]
                    held.append(row)
            if held:
                yield held

        doc, other, count = [], [], []
        for rows in groups():
            _, one, two, tile, ids, size, k, head, weight, keys = zip(*rows, strict=True)
            ids, size, k, head, weight, tile = (np.array(x) for x in (ids, size, k, head, weight, tile))
            sets = [np.frombuffer(x, "<u8") for x in keys]
            left, right = (np.flatnonzero(tile == t[0]) for t in (one, two))
            links = tile_links(size, k, sets, left, right, percent, head)
            if not links.any():
                continue
            degree = np.zeros(len(ids), np.int64)
            degree[left] += links @ weight[right]
            if one[0] != two[0]:
                degree[right] += links.T @ weight[left]
            some = np.flatnonzero(degree)
            edges = spanning_forest(links, left, right, len(ids))
            doc += ids[some].tolist() + [int(ids[x]) for x, _ in edges]
            other += [None] * len(some) + [int(ids[y]) for _, y in edges]
            count += degree[some].tolist() + [0] * len(edges)
            if len(doc) > 50_000:
                yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc, other, count)], ["doc", "other", "links"])
                doc, other, count = [], [], []
        if doc:
            yield pa.record_batch([pa.array(x, pa.int64()) for x in (doc, other, count)], ["doc", "other", "links"])

    return run


def _by_rare(prefixed: DataFrame, percent: int) -> DataFrame:
    """Links of pairs that share a rare prefix shingle: the entries of each are at most RARE, so lists of them are short."""
    entry = prefixed.select(F.explode("rare").alias("token"), F.struct("doc", "size", "k", "frequent").alias("d"))
    groups = entry.groupBy("token").agg(F.array_sort(F.collect_list("d")).alias("d")).where(F.size("d") > 1)
    fits = lambda x, y: (100 * x["size"] >= percent * y["size"]) & (100 * y["size"] >= percent * x["size"])
    later = lambda x: F.transform(F.filter("d", lambda y: (y["doc"] > x["doc"]) & fits(x, y)), lambda y: F.struct(x["doc"].alias("a"), y["doc"].alias("b"), (F.least(x["k"], y["k"]) - F.least(x["frequent"], y["frequent"])).alias("least")))
    pairs = groups.select(F.explode(F.flatten(F.transform("d", later))).alias("p")).select("p.*")
    pairs = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.first("least").alias("least")).where("n >= least").select("a", "b")
    for s in "ab":
        pairs = pairs.join(prefixed.select(F.col("doc").alias(s), F.col("size").alias(f"size_{s}"), F.col("weight").alias(f"weight_{s}"), F.col("keys").alias(f"keys_{s}")), s)
    both = pairs.select("a", "b", "size_a", "size_b", "weight_a", "weight_b", "keys_a", "keys_b")
    return both.mapInArrow(lean(_verified(percent)), "doc long, other long, links long")


def _by_frequent(prefixed: DataFrame, percent: int) -> DataFrame:
    """Links of the other pairs, from tiles of clusters that frequent prefix shingles connect."""
    entry = prefixed.select("doc", F.explode("tail").alias("token"))
    pivot = entry.groupBy("token").agg(F.min("doc").alias("pivot"), F.max("doc").alias("last")).where("pivot < last").select("token", "pivot")
    cluster = components(entry.join(pivot, "token").select(F.col("doc").alias("a"), F.col("pivot").alias("b")))
    # Sizes of partners differ by less than one band of this width, which leaves room for rounding.
    band = F.floor(F.ln("size") / float(-np.log(percent / 100) * (1 + 1e-9))).cast("int") if percent < 100 else F.col("size").cast("int")
    cluster = cluster.select(F.col("node").alias("doc"), F.col("component").alias("cluster"))
    member = prefixed.select("doc", "size", "k", "head", "weight", "keys").join(cluster, "doc").withColumn("band", band)
    bands = member.groupBy("cluster", "band").agg(F.greatest(F.ceil(F.count(F.lit(1)) / TILE), F.ceil(F.sum(F.length("keys")) / TILE_BYTES)).cast("int").alias("tiles"))
    bands = written(bands, "bands")
    mine = bands.select(F.col("cluster").alias("of"), F.col("band").alias("mine"), F.col("tiles").alias("own_tiles"))
    placed = member.join(mine, (F.col("cluster") == F.col("of")) & (F.col("band") == F.col("mine"))).drop("of", "mine")
    place = lambda b, t: b.cast("long") * (1 << 32) + t
    placed = placed.withColumn("tile", place(F.col("band"), F.pmod(F.xxhash64("doc"), F.col("own_tiles"))))
    met = placed.withColumn("near", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))))
    theirs = bands.select(F.col("cluster").alias("of"), F.col("band").alias("theirs"), F.col("tiles").alias("their_tiles"))
    met = met.join(theirs, (F.col("cluster") == F.col("of")) & (F.col("near") == F.col("theirs")))
    met = met.withColumn("with", F.explode(F.transform(F.sequence(F.lit(0), F.col("their_tiles") - 1), lambda t: place(F.col("near"), t))))
    keys = ["cluster", "one", "two"]
    tiled = met.select("cluster", F.least("tile", "with").alias("one"), F.greatest("tile", "with").alias("two"), "tile", "doc", "size", "k", "head", "weight", "keys")
    return tiled.repartition(partitions(prefixed.sparkSession), *keys).sortWithinPartitions(*keys).mapInArrow(lean(_tiles(percent)), "doc long, other long, links long")


def jaccard_components(docs: DataFrame, words: int = 5, percent: int = 75, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id (smallest document with the same set) and n_links of every row.

    Two documents link when 100 * shared >= percent * union of their shingles.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs, ids = told_apart(docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("text")), "doc")
    known = docs.where("doc is not null")
    bits = bucket_bits(docs, "text")
    table = X.shared_keys(known.mapInArrow(lean(_send_shingles(words, bits)), X.PACKED), bits, SHINGLE_BYTES)
    likely = F.expr(f"size > 0 and 100 * n_shared >= {percent} * size")
    table = written(table.select("doc", F.when(F.col("size") > 0, F.col("sig")).alias("sig"), "size", F.when(likely, F.col("keys")).alias("keys"), F.when(likely, F.col("counts")).alias("counts")), "sets")
    facts = table.join(X.classes(table), "sig", "left").select("doc", "size", F.coalesce("rep", "doc").alias("rep"), F.coalesce("n", F.lit(1)).alias("weight"), "keys", "counts")

    own = facts.where("rep = doc and keys is not null").select("doc", "size", "weight", "keys", "counts")
    prefixed = own.drop("weight").mapInArrow(lean(_prefixes(percent, RARE)), "doc long, size long, k int, head int, frequent int, rare array<long>, tail array<long>, keys binary")
    prefixed = written(prefixed.join(own.select("doc", "weight"), "doc"), "prefixes")
    found = written(_by_rare(prefixed, percent).union(_by_frequent(prefixed, percent)), "links")
    joined = components(found.where("other is not null").select(F.col("doc").alias("a"), F.col("other").alias("b")))
    degree = found.where("other is null").groupBy("doc").agg(F.sum("links").alias("links"))

    at_class = joined.toDF("rep", "component").join(degree.withColumnRenamed("doc", "rep"), "rep", "full")
    at_class = at_class.withColumn("rep", F.greatest("rep", "rep"))  # as in ``classes``: a class may hold very many documents
    result = facts.select("doc", "size", "rep", "weight").join(at_class, "rep", "left").select(
        F.col("doc").alias("doc_id"), F.col("size").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"),
        F.col("rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
    )
    result = known.select(F.col("doc").alias("doc_id")).join(result, "doc_id")
    nameless = docs.where("doc is null").select("text").mapInArrow(lean(_count_only(words)), "n_shingles long")
    null = F.lit(None).cast("long")
    result = result.union(nameless.select(null, "n_shingles", null, null, F.lit(0).cast("long")))
    return named_again(result, ids, "doc_id", "component_id", "class_id")
