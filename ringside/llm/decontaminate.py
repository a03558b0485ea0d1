"""Operator 9, benchmark decontamination: prefix-filtered set join.

An item's windows are its runs of ``length`` words (a shorter item is one window). A window is contained in a document
only if all its shingles are, so one shingle is a necessary prefix: with shingles ordered by their frequency in all
documents, the rarest. Documents are joined on these prefix shingles alone; the shingle's place in the window and the
document's ends bound where the window could lie; and what remains is verified word by word.

The join is one at every size: rarest shingle, bounds, comparison of words. Only its physical form is chosen: where the
windows and their items were counted and are at most ``broadcast_windows`` (and eight times that), the benchmark's side is
sent to every task; else both sides meet in a shuffle, where Spark splits partitions of shingles that very many documents
hold; a Bloom filter of fixed size keeps back the shingles of documents that no window holds. Either way a row is judged by its own text, whatever its doc_id, and both give the same rows.

Defined results: null texts have no words and are clean; items without words, or with a null id or text, take no part;
items that repeat count once; repeated documents get equal results; empty tables give empty or clean results; further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean, LOWER, NOT_ALNUM, U64, changes, gram_hashes, inside_texts, slices, spread, text_buffers, word_hashes, word_spans
from ringside.llm.rows import by_place
from ringside.llm.session import small_batches, written

#: Words of a shingle.
SHINGLE = 3
#: Windows that may be broadcast: about 100 bytes each.
BROADCAST_WINDOWS = 1 << 18
#: Bits of the filter of windows' shingles where they are not broadcast: 8 MB.
SIEVE_BITS = 1 << 26
FOUND = "n_words long, n_hit long, items array<long>"


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = word_spans(data, offsets, NOT_ALNUM)
    return data, starts, ends, first, word_hashes(data, starts, ends)


def shingles(tokens: np.ndarray, n: int) -> np.ndarray:
    return tokens if n == 1 else gram_hashes(tokens, n)


@dataclass
class Bench:
    """Distinct windows: word hashes (rows padded with 0), number of words, text with one blank between, and items."""

    words: np.ndarray
    size: np.ndarray
    text: list[bytes]
    items: list[list[int]]

    def tokens(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every window's shingles: window, place, shingle length, hash."""
        window, place, length, value = [], [], [], []
        for n in np.unique(np.minimum(self.size, SHINGLE)).tolist():
            at = np.flatnonzero(np.minimum(self.size, SHINGLE) == n)
            table = self.words[at]
            for j in range(table.shape[1] - n + 1):
                ok = self.size[at] >= j + n
                if ok.any():
                    rows = table[ok, j : j + n]
                    value.append(rows[:, 0] if n == 1 else gram_hashes(rows.reshape(-1), n)[::n])
                    window.append(at[ok])
                    place.append(np.full(ok.sum(), j))
                    length.append(np.full(ok.sum(), n))
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (window, place, length, value))


def _windows(length: int) -> Callable:
    """item_id, text -> item_id, window (words with one blank between)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item, out = [], []
            data, offsets = text_buffers(batch.column(1))
            data, starts, ends, first, _ = words_of(data, offsets)
            words = [data[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            for i, name in enumerate(batch.column(0).to_pylist()):
                own = words[first[i] : first[i + 1]]
                for k in range(max(1, len(own) - length + 1) if own else 0):
                    item.append(name)
                    out.append(b" ".join(own[k : k + length]))
            yield pa.record_batch([pa.array(item, pa.int64()), pa.array(out, pa.binary())], ["item_id", "window"])

    return run


def bench_of(rows: list, length: int) -> Bench:
    text = [bytes(r["window"]) for r in rows]
    data = np.frombuffer(b" ".join(text), np.uint8)
    starts, ends, first = word_spans(data, np.concatenate(([0], np.cumsum([len(t) + 1 for t in text]) - 1))[: len(text) + 1] if text else np.zeros(1, np.int64), NOT_ALNUM)
    hashes = word_hashes(data, starts, ends)
    size = np.array([t.count(b" ") + 1 for t in text], dtype=np.int64)
    table = np.zeros((len(text), length), U64)
    if len(text):
        row = np.repeat(np.arange(len(text)), size)
        table[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = hashes
    return Bench(table, size, text, [sorted(r["items"]) for r in rows])


class Prefilter:
    """Which hashes are in a small sorted set: a bit table first, then a search."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = np.unique(values)
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(self.values & U64((1 << 20) - 1)).astype(np.int64)] = True

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a known hash stands, and which one."""
        at = np.flatnonzero(self.bits[(hashes & U64((1 << 20) - 1)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        which = np.minimum(np.searchsorted(self.values, hashes[at]), len(self.values) - 1)
        ok = self.values[which] == hashes[at]
        return at[ok], which[ok]


def _frequencies(known: dict[int, np.ndarray]) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {n: Prefilter(v) for n, v in known.items()}
        total = {n: np.zeros(len(t.values), np.int64) for n, t in tables.items()}
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            for i, j in slices(offsets):
                *_, tokens = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for n, table in tables.items():
                    total[n] += np.bincount(table.places(shingles(tokens, n))[1], minlength=len(table.values))
        for n, t in total.items():
            at = np.flatnonzero(t)
            yield pa.record_batch([pa.array(np.full(len(at), n)), pa.array(tables[n].values[at].view(np.int64)), pa.array(t[at])], ["n", "shingle", "count"])

    return run


def _match(bench: Bench, prefix: list[tuple]) -> Callable:
    """prefix: for each shingle length, windows ordered by their prefix shingle: (length, shingles, windows, places)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = []
        for n, value, window, place in prefix:
            table = Prefilter(value)
            tables.append((n, table, np.searchsorted(value, table.values), np.searchsorted(value, table.values, "right"), window, place))
        for batch in batches:
            data, offsets = text_buffers(batch.column(1))
            n_words, n_hit, items = [], [], []
            for i, j in slices(offsets):
                part, starts, ends, first, tokens = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                at_window, at_start, at_doc = [], [], []
                for n, table, low, high, window, place in tables:
                    pos, which = table.places(shingles(tokens, n))
                    count = (high - low)[which]
                    entry = spread(low[which], count)
                    pos, w = np.repeat(pos, count), window[entry]
                    begin = pos - place[entry]
                    doc = np.searchsorted(first, pos, "right") - 1
                    ok = (begin >= first[doc]) & (begin + bench.size[w] <= first[doc + 1])
                    begin, doc, w = begin[ok], doc[ok], w[ok]
                    equal = np.ones(len(w), bool)
                    for k in range(bench.words.shape[1]):
                        inside = bench.size[w] > k
                        equal &= ~inside | (tokens[np.minimum(begin + k, len(tokens) - 1)] == bench.words[w, k])
                    at_window.append(w[equal])
                    at_start.append(begin[equal])
                    at_doc.append(doc[equal])
                w, begin, doc = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at_window, at_start, at_doc))
                exact = np.fromiter(
                    (b" ".join([part[starts[x] : ends[x]].tobytes() for x in range(b, b + bench.size[k])]) == bench.text[k] for k, b in zip(w.tolist(), begin.tolist(), strict=True)), bool, len(w)
                )
                w, begin, doc = w[exact], begin[exact], doc[exact]
                step = np.zeros(len(tokens) + 1, np.int64)
                np.add.at(step, begin, 1)
                np.add.at(step, begin + bench.size[w], -1)
                hits = np.concatenate(([0], np.cumsum(np.cumsum(step[:-1]) > 0)))
                n_words += np.diff(first).tolist()
                n_hit += (hits[first[1:]] - hits[first[:-1]]).tolist()
                own: list[set[int]] = [set() for _ in range(j - i)]
                for d, k in set(zip(doc.tolist(), w.tolist(), strict=True)):
                    own[d].update(bench.items[k])
                items += [sorted(x) for x in own]
            yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items"])

    return run


def _doc_shingles(sizes: list[int], sieve: np.ndarray) -> Callable:
    """row, text -> the shingles that pass the sieve, with their place and the number of words: for the join without a broadcast."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            data, offsets = text_buffers(batch.column(1))
            for i, j in slices(offsets):
                *_, first, tokens = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                for n in sizes:
                    at, doc = inside_texts(first, n, len(tokens))
                    value = shingles(tokens, n)[at]
                    ok = _passes(sieve, value)
                    at, doc, value = at[ok], doc[ok], value[ok]
                    if len(at):
                        yield pa.record_batch(
                            [ids.take(pa.array(doc + i)), pa.array(at - first[doc]), pa.array(np.diff(first)[doc]), pa.array(np.full(len(at), n)), pa.array(value.view(np.int64))],
                            ["row", "at", "n_words", "n", "shingle"],
                        )

    return run


def _window_shingles(length: int) -> Callable:
    """window -> its shingles: window, number of words, place, shingle length and shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bench = bench_of([{"window": w, "items": []} for w in batch.column(0).to_pylist()], length)
            window, place, n, value = bench.tokens()
            if len(window):
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(window)), pa.array(bench.size[window]), pa.array(place), pa.array(n), pa.array(value.view(np.int64))],
                    ["window", "size", "place", "n", "shingle"],
                )

    return run


def verified(text: bytes, starts: list[int], ends: list[int], places: list[dict] | None) -> tuple[int, list[int]]:
    """How many words of a text lie in a window, and the items, of those windows that the words at their place equal."""
    hit, items = np.zeros(len(starts), bool), set()
    for p in places or ():
        begin, window = p["begin"], bytes(p["window"])
        end = begin + window.count(b" ") + 1
        if 0 <= begin and end <= len(starts) and b" ".join([text[a:b] for a, b in zip(starts[begin:end], ends[begin:end], strict=True)]) == window:
            hit[begin:end] = True
            items.update(p["items"])
    return int(hit.sum()), sorted(items)


def _judged(text: int, places: int) -> Callable:
    """For each batch: number of words, words in windows, and items of every row."""

    def run(batch: pa.RecordBatch) -> tuple[list, list, list]:
        data, offsets = text_buffers(batch.column(text))
        n_words, n_hit, items = [], [], []
        for i, j in slices(offsets):
            part, starts, ends, first, _ = words_of(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            whole = part.tobytes()
            for k, found in enumerate(batch.column(places).slice(i, j - i).to_pylist()):
                own = slice(first[k], first[k + 1])
                hit, names = verified(whole, starts[own].tolist(), ends[own].tolist(), found)
                n_words.append(int(first[k + 1] - first[k]))
                n_hit.append(hit)
                items.append(names)
        return n_words, n_hit, items

    return run


def _count_hits(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    judge = _judged(1, 2)
    for batch in batches:
        n_words, n_hit, items = judge(batch)
        yield pa.record_batch([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items"])


def _without_hits(text: int, columns: int) -> Callable:
    """The first ``columns`` columns of the rows without a hit; the places come next."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judged(text, columns)
        for batch in batches:
            n_hit = np.array(judge(batch)[1], np.int64)
            yield batch.select(list(range(columns))).filter(pa.array(n_hit == 0))

    return run


def _prepared(docs: DataFrame, benchmark: DataFrame, length: int, broadcast_windows: int) -> tuple[Callable | None, DataFrame]:
    """What finds the windows in a batch of doc_id and text, if they may be broadcast; and the windows."""
    small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    windows = items.mapInArrow(lean(_windows(length)), "item_id long, window binary")
    distinct = windows.groupBy("window").agg(F.collect_set("item_id").alias("items"))
    n, entries = distinct.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("items")), F.lit(0))).first()
    if n > broadcast_windows or entries > 8 * broadcast_windows:
        return None, windows
    rows = distinct.collect()
    bench = bench_of(sorted(rows, key=lambda r: bytes(r["window"])), length)
    window, place, size, value = bench.tokens()
    sizes = np.unique(size).tolist()
    known = {n: np.unique(value[size == n]) for n in sizes}
    counted = docs.select("text").mapInArrow(lean(_frequencies(known)), "n long, shingle long, count long") if sizes else None
    frequency = {(r["n"], r["shingle"]): r["count"] for r in counted.groupBy("n", "shingle").agg(F.sum("count").alias("count")).collect()} if sizes else {}
    rarity = np.fromiter((frequency.get(k, 0) for k in zip(size.tolist(), value.view(np.int64).tolist(), strict=True)), np.int64, len(value))
    order = np.lexsort((place, value, rarity, window))
    order = order[changes(window[order])]
    order = order[rarity[order] > 0]  # a shingle that no document holds
    prefix = []
    for n in sizes:
        at = order[size[order] == n]
        at = at[np.argsort(value[at], kind="stable")]
        prefix.append((n, value[at], window[at], place[at]))
    return _match(bench, prefix), windows


def contamination(docs: DataFrame, benchmark: DataFrame, length: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit and items (ids of the items with a window in the text) of every document."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    match, windows = _prepared(docs, benchmark, length, broadcast_windows)
    return _shuffled(docs, windows, length) if match is None else docs.mapInArrow(lean(match), f"doc_id long, {FOUND}")


def _clean(match: Callable, at: int) -> Callable:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.record_batch([pa.nulls(batch.num_rows), batch.column(at)], ["doc_id", "text"])
            for out in match([texts]):
                yield batch.filter(pc.equal(out.column(2), 0))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, length: int = 10, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """The rows of ``docs``, whole, whose text holds no window of an item."""
    match, windows = _prepared(docs, benchmark, length, broadcast_windows)
    rows, at = by_place(docs), docs.columns.index("text")
    if match is not None:
        return rows.mapInArrow(lean(_clean(match, at)), rows.schema).toDF(*docs.columns)
    placed = _placed(rows, f"c{docs.columns.index('doc_id')}", f"c{at}", windows.select(F.lit(0).cast("long").alias("item_id"), "window"), length)
    return placed.mapInArrow(lean(_without_hits(at, len(docs.columns))), rows.schema).toDF(*docs.columns)


def _shuffled(docs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    return _placed(by_place(docs), "c0", "c1", windows, length).mapInArrow(lean(_count_hits), f"doc_id long, {FOUND}")


def _sieve(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of some shingles, of a fixed size: made in a grouped aggregation, sent to every task."""
    low, high = F.col("shingle").bitwiseAND(F.lit(SIEVE_BITS - 1)), F.shiftrightunsigned("shingle", 32).bitwiseAND(F.lit(SIEVE_BITS - 1))
    bits = shingles.select(F.explode(F.array(low, high)).alias("bit"))
    words = bits.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("mask")).toArrow()
    sieve = np.zeros(SIEVE_BITS // 64, U64)
    sieve[words.column("word").to_numpy()] = words.column("mask").to_numpy().view(U64)
    return sieve


def _passes(sieve: np.ndarray, value: np.ndarray) -> np.ndarray:
    def held(bit: np.ndarray) -> np.ndarray:
        return (sieve[(bit >> U64(6)).astype(np.int64)] >> (bit & U64(63))) & U64(1) == U64(1)

    ok = held(value & U64(SIEVE_BITS - 1))
    ok[ok] = held((value[ok] >> U64(32)) & U64(SIEVE_BITS - 1))
    return ok


def _placed(docs: DataFrame, doc_id: str, text: str, windows: DataFrame, length: int) -> DataFrame:
    """``docs`` (columns c0, c1, ...), whole, and last the places at which windows could lie: of equal hashes, so words are still to be compared.

    Rows are told apart by a hash of id and text; rows of equal hash share their places, and each is compared itself.
    """
    distinct = written(windows.groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")), "windows")
    own = written(distinct.select("window").mapInArrow(lean(_window_shingles(length)), "window binary, size long, place long, n long, shingle long"), "shingles")
    sizes = [r["n"] for r in own.select("n").distinct().orderBy("n").collect()]
    keyed = docs.withColumn("row", F.xxhash64(doc_id, text))
    texts = keyed.where(F.col(text).isNotNull()).select("row", F.col(text).cast("string").alias("text"))
    # Only shingles that a window may hold leave their task; of those that do, all are counted.
    at = written(texts.mapInArrow(lean(_doc_shingles(sizes, _sieve(own))), "row long, at long, n_words long, n long, shingle long"), "candidates")
    counts = at.groupBy("n", "shingle").agg(F.count(F.lit(1)).alias("count"))
    # The rarest shingle is one that no document holds, if there is one: then the window is in none.
    held = own.join(counts, ["n", "shingle"], "left").groupBy("window", "size", "n")
    rarest = held.agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "shingle", "place")).alias("p")).where("p.count > 0")
    prefix = rarest.select("window", "size", "n", "p.shingle", "p.place").join(distinct, "window")
    begin = F.col("at") - F.col("place")
    inside = at.join(prefix, ["n", "shingle"]).where((begin >= 0) & (begin + F.col("size") <= F.col("n_words")))
    found = inside.groupBy("row").agg(F.collect_set(F.struct(begin.alias("begin"), "window", "items")).alias("places"))
    return keyed.join(found, "row", "left").select(*docs.columns, "places")
