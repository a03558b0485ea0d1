"""Operator 1, language identification: hyperdimensional profiles.

Every letter has a random vector of +-1, fixed by its code point. A trigram binds the vectors of its letters, each
permuted by its place (an element-wise product of rotated vectors); a text bundles its trigrams (a sum), and so does
a language over all its training texts. A text's language is the prototype of largest cosine, also where all cosines are
below 0; the score is that cosine, 0 where it is below.

Training adds up whole partitions: each sends one integer vector per language, summed by Spark. What reaches the
driver, and goes back to the tasks, is one vector per language, whatever the corpus. Where labels name more than ``MOST``
languages, their vectors stay in a written table and come in blocks of so many, and a text keeps the best of all blocks.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if nothing was
learned; ties go to the first language by code point; rows with null lang or null doc_id train nothing, and
held_out is false for a null doc_id; repeated rows get equal results; an empty table gives an empty result; further
columns are ignored. Upper and lower case count alike, runs of anything but letters count as one blank.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ringside.llm.arrays import lean, U64, mix64
from ringside.llm.rows import by_place
from ringside.llm.session import numbered, small_batches, written

#: Elements of a vector.
SIZE = 1024
GRAM = 3
UNKNOWN = "und"
#: Characters, texts and distinct trigrams that are bundled at a time.
CHUNK, MANY, SLICE = 1 << 17, 256, 1 << 12
#: Of texts with so many different trigrams, random letters score below the least score and clean texts above it: of 10,000
#: documents the lowest such score was 0.21; of 3,000 texts of letters drawn evenly from two alphabets, 2 were above 0.12.
LEAST_VARIETY, LEAST_SCORE = 50, 0.12
#: Below this score a text must also beat its own letters in random order, on average of so many orders, by a margin. Of
#: random texts of 12 to 26 Latin letters almost all score below it and within the margin, of clean documents none. Texts of
#: less than twice the variety, or that repeat their trigrams so many times on average, aren't asked: they aren't random.
CLEAR_SCORE, SHUFFLES, MARGIN, REPEATS = 0.3, 3, 0.12, 10
#: Cosines that a matrix product can't tell apart, and pairs of texts and languages that are then multiplied at a time.
NEAR, PAIRS = 1e-9, 1 << 12
#: Languages that a task holds at a time.
MOST = 8192
_letters: list[np.ndarray] = []


def is_letter() -> np.ndarray:
    """For every code point: is it a letter?"""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_vectors(points: np.ndarray) -> np.ndarray:
    """The random vectors of some code points, as packed bits."""
    lanes = np.arange(SIZE // 64, dtype=U64)
    return mix64(mix64(points.astype(U64)[:, None] + U64(0x9E3779B97F4A7C15)) + lanes[None] * U64(0xD1B54A32D192ED03)).view(np.uint8)


def bound(grams: np.ndarray) -> np.ndarray:
    """The vectors of trigrams (rows of code points): +-1 as float32. On bits, the product is an exclusive or."""
    points, place = np.unique(grams, return_inverse=True)
    bits = np.unpackbits(letter_vectors(points), axis=1)
    place = place.reshape(grams.shape)
    out = None
    for j in range(GRAM):
        turned = np.packbits(np.roll(bits, GRAM - 1 - j, axis=1), axis=1)[place[:, j]]
        out = turned if out is None else out ^ turned
    return np.unpackbits(out, axis=1).astype(np.float32) * 2 - 1


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every trigram of some texts as one number, its text, and which texts have a letter."""
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    text = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    letter = is_letter()[points]
    has = np.bincount(text[letter], minlength=len(texts)) > 0
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1] | (text[1:] != text[:-1])
    points, text = np.where(letter, points, 0x20)[kept].astype(U64), text[kept]
    inside = text[GRAM - 1 :] == text[: len(text) - GRAM + 1]
    return (points[:-2] << U64(42) | points[1:-1] << U64(21) | points[2:])[inside], text[: len(text) - GRAM + 1][inside], has


def bundles(texts: list[str], row: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bundled vector of every text (or of all texts with one row number), its number of different trigrams, and
    whether each text has a letter.

    Trigrams' vectors exist for one slice at a time.
    """
    gram, text, has = grams_of(texts)
    distinct, column = np.unique(gram, return_inverse=True)
    if row is not None:
        text = row[text]
    n = len(texts) if row is None else int(row.max()) + 1
    total, variety = np.zeros((n, SIZE), np.float32), np.zeros(n, np.int64)
    order = np.argsort(column, kind="stable") if len(distinct) > SLICE else np.arange(len(column))
    column, text = column[order], text[order]
    low = U64((1 << 21) - 1)
    for i in range(0, len(distinct), SLICE):
        own = distinct[i : i + SLICE]
        at = slice(*np.searchsorted(column, (i, i + SLICE))) if len(distinct) > SLICE else slice(None)
        counts = np.bincount(text[at] * len(own) + (column[at] - i), minlength=n * len(own)).reshape(n, len(own))
        variety += np.count_nonzero(counts, axis=1)
        total += counts.astype(np.float32) @ bound(np.stack((own >> U64(42), own >> U64(21) & low, own & low), axis=1))
    return total, variety, has


def single_blanks(text: str) -> str:
    """Letters, and one blank for all that is between."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    letter = is_letter()[points]
    kept = letter.copy()
    kept[0] = True
    kept[1:] |= letter[:-1]
    return np.where(letter, points, 0x20)[kept].astype("<u4").tobytes().decode("utf-32-le")


def pieces(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, lower-cased and between blanks, of about CHUNK characters together, at most MANY of them.

    A longer text comes in pieces that share all but one character of a trigram.
    """
    owner: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        t = f" {(t or '').lower()} "
        if len(t) > CHUNK:
            t = single_blanks(t)
        for begin in range(0, len(t), CHUNK):
            owner.append(i)
            held.append(t[max(0, begin - GRAM + 1) : begin + CHUNK])
            size += len(held[-1])
            if size >= CHUNK or len(held) >= MANY:
                yield owner, held
                owner, held, size = [], [], 0
    if held:
        yield owner, held


def bundled(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``bundles``, for any number of texts of any length, in bounded pieces (different trigrams: those of the richest piece)."""
    total, variety, has = np.zeros((len(texts), SIZE), np.float64), np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
    for owner, some in pieces(texts):
        vectors, different, letters = bundles(some)
        np.add.at(total, owner, vectors)
        np.maximum.at(variety, owner, different)
        np.logical_or.at(has, owner, letters)
    return total, variety, has


def _learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for i in range(0, batch.num_rows, MANY):
            langs, row = np.unique(np.array(batch.column(1).slice(i, MANY).to_pylist(), dtype=object), return_inverse=True)
            for owner, some in pieces(batch.column(0).slice(i, MANY).to_pylist()):
                own, at = np.unique(row[owner], return_inverse=True)
                for k, v in zip(own.tolist(), bundles(some, at)[0], strict=True):
                    total[langs[k]] = total.get(langs[k], 0) + v.astype(np.int64)
    if total:
        yield pa.record_batch([pa.array(list(total)), pa.array([v.tolist() for v in total.values()], pa.list_(pa.int64()))], ["lang", "vector"])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


class Prototypes:
    """The languages of a table text, lang: unit vectors in blocks of ``MOST`` languages, by code point.

    One block is what a task holds; where there are more, the vectors stay in a written table.
    """

    def __init__(self, labelled: DataFrame) -> None:
        small_batches(labelled.sparkSession)
        parts = labelled.where("lang is not null").mapInArrow(lean(_learn), "lang string, vector array<long>")
        summed = parts.select("lang", F.posexplode("vector").alias("place", "value")).groupBy("lang", "place").agg(F.sum("value").alias("value"))
        self.table = written(summed.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "value"))), lambda x: x["value"]).alias("vector")), "prototypes")
        self.count = max(1, -(-self.table.count() // MOST))
        if self.count > 1:
            self.table = written(numbered(self.table, "lang", "number"), "blocks")

    def block(self, k: int) -> tuple[list[str], np.ndarray]:
        rows = (self.table if self.count == 1 else self.table.where(F.floor(F.col("number") / MOST) == k)).orderBy("lang").collect()
        table = np.array([r["vector"] for r in rows], dtype=np.float64).reshape(len(rows), SIZE)
        return [r["lang"] for r in rows], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-300)

    def best(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column text) and lang_pred, score, cosine and variety: the best of one block after another."""
        schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("lang_pred string, score double, cosine double, variety long").fields])
        at = rows.columns.index("text")
        for k in range(self.count):
            rows = rows.mapInArrow(lean(_predict(*self.block(k), at, k > 0)), schema)
            if k + 1 < self.count:
                rows = written(rows, "best")
        return rows


def nearest(table: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the largest cosine, the first of equals, which may be below 0, and that cosine.

    A matrix product rounds by its shape, so those that it finds within ``NEAR`` of the largest are summed by themselves: a
    cosine doesn't depend on which other languages and texts are in the block.
    """
    norm = np.maximum(np.linalg.norm(vectors, axis=1), 1e-300)
    rough = vectors @ table.T / norm[:, None]
    near = rough >= rough.max(axis=1, keepdims=True) - NEAR
    near[~vectors.any(axis=1), 1:] = False
    row, place = np.nonzero(near)
    cosine = np.full(rough.shape, -np.inf)
    for i in range(0, len(row), PAIRS):
        r, k = row[i : i + PAIRS], place[i : i + PAIRS]
        cosine[r, k] = (vectors[r] * table[k]).sum(axis=1) / norm[r]
    best = cosine.argmax(axis=1)
    return best, cosine[np.arange(len(best)), best]


def judged(langs: list[str], table: np.ndarray, vectors: np.ndarray, has: np.ndarray) -> tuple[list[str], list[float]]:
    """The language of largest cosine, and that cosine as a score of 0 to 1."""
    if not langs:
        return [UNKNOWN] * len(has), [0.0] * len(has)
    best, cosine = nearest(table, vectors)
    return [langs[k] if ok else UNKNOWN for k, ok in zip(best.tolist(), has.tolist(), strict=True)], np.where(has, np.clip(cosine, 0, 1), 0.0).tolist()


def _predict(langs: list[str], table: np.ndarray, at: int, again: bool) -> Callable:
    """Every row with its best language of this block, or, ``again``, the better one of it and the last four columns'."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, cosines, varieties = [], [], [], []
            for i in range(0, batch.num_rows, MANY):
                vectors, different, has = bundled(batch.column(at).slice(i, MANY).to_pylist())
                own, score = judged(langs, table, vectors, has)
                names += own
                scores += score
                cosines += nearest(table, vectors)[1].tolist() if langs else [-2.0] * len(own)
                varieties += different.tolist()
            columns = batch.columns
            if again:
                *columns, old_names, old_scores, old_cosines, _ = columns
                old = zip(old_cosines.to_pylist(), old_names.to_pylist(), old_scores.to_pylist(), strict=True)
                # Blocks come by code point, so that the first one keeps a tie.
                chosen = [o if o[0] >= c else (c, n, x) for o, c, n, x in zip(old, cosines, names, scores, strict=True)]
                cosines, names, scores = map(list, zip(*chosen, strict=True)) if chosen else ([], [], [])
            made = [pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(cosines, pa.float64()), pa.array(varieties, pa.int64())]
            kept = batch.schema.names[: len(columns)]
            yield pa.record_batch([*columns, *made], [*kept, "lang_pred", "score", "cosine", "variety"])

    return run


def predict_language(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", keep_text: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row (and its text, if asked for).

    Learns from rows with a language whose doc_id is not held out; predicts from the text alone.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"), held_out(doc_id).alias("held_out"))
    found = Prototypes(docs.where("not held_out and doc_id is not null").select("text", "lang")).best(docs.select("doc_id", "text", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", *(["text"] if keep_text else []))


def shuffled(text: str) -> str:
    """The same letters in a pseudorandom order that depends on the text alone."""
    points = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
    return np.random.default_rng([zlib.crc32(text.encode()), len(text)]).permutation(points).astype("<u4").tobytes().decode("utf-32-le")


def doubtful(langs: list[str], table: np.ndarray, texts: list[str], score: np.ndarray) -> np.ndarray:
    """Is a text no more like a language than its own letters in random order are?"""
    again = np.zeros((SHUFFLES, len(texts)))
    for k in range(SHUFFLES):
        texts = [shuffled(t) for t in texts]
        vectors, _, has = bundled(texts)
        again[k] = judged(langs, table, vectors, has)[1]
    return score - again.mean(axis=0) < MARGIN


def _shuffles(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """place, text -> place, number and text of its random orders, each of the one before as ``doubtful`` has them."""
    for batch in batches:
        for place, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            texts = []
            for _ in range(SHUFFLES):
                texts.append(t := shuffled(t))
            yield pa.record_batch([pa.array([place] * SHUFFLES, pa.int64()), pa.array(range(SHUFFLES), pa.int32()), pa.array(texts, pa.string())], ["place", "number", "text"])


def _likeness(langs: list[str], table: np.ndarray, at: int, least: float, clear: float, variety: int) -> Callable:
    """Whole rows whose text (column ``at``) is like a known language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, MANY):
                some = batch.slice(i, MANY)
                texts = some.column(at).to_pylist()
                vectors, different, has = bundled(texts)
                names, values = judged(langs, table, vectors, has)
                score, known = np.array(values), np.array(names, object) != UNKNOWN
                kept = known & ((different < variety) | (score >= least))
                long = np.fromiter((len(t or "") for t in texts), np.int64, len(texts))
                asked = np.flatnonzero(kept & (score < clear) & (different >= 2 * variety) & (REPEATS * different >= long))
                if len(asked):
                    kept[asked] = ~doubtful(langs, table, [texts[k] for k in asked.tolist()], score[asked])
                yield some.filter(pa.array(kept, pa.bool_()))

    return run


def known_language(docs: DataFrame, least: float = LEAST_SCORE, clear: float = CLEAR_SCORE, variety: int = LEAST_VARIETY, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs``, whole, whose text has a language: letters, and a score of at least ``least``; below ``clear``,
    it must also be more like a language than the same letters in random order.

    A text of fewer than ``variety`` different trigrams says too little for a score to count against it.
    """
    learn = docs.where(~held_out(doc_id) & F.col(doc_id).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = by_place(docs)
    blocks = Prototypes(learn)
    if blocks.count > 1:
        # More languages than one task should hold: texts, and their letters in random order, meet one block after another.
        own = F.col(f"c{docs.columns.index(text)}")
        best = written(blocks.best(rows.select("*", own.alias("text"), F.monotonically_increasing_id().alias("place"))), "judged")
        known = best.where((F.col("lang_pred") != UNKNOWN) & ((F.col("variety") < variety) | (F.col("score") >= least)))
        asked = known.where((F.col("score") < clear) & (F.col("variety") >= 2 * variety) & (REPEATS * F.col("variety") >= F.length("text")))
        again = blocks.best(asked.select("place", "text").mapInArrow(lean(_shuffles), "place long, number int, text string"))
        # Summed in their order, as in one task.
        mean = F.aggregate(F.array_sort(F.collect_list(F.struct("number", "score"))), F.lit(0.0), lambda total, x: total + x["score"]) / SHUFFLES
        doubted = again.groupBy("place").agg(mean.alias("mean")).join(asked.select("place", "score"), "place").where(F.col("score") - F.col("mean") < MARGIN)
        return known.join(doubted.select("place"), "place", "left_anti").select(*rows.columns).toDF(*docs.columns)
    return rows.mapInArrow(lean(_likeness(*blocks.block(0), docs.columns.index(text), least, clear, variety)), rows.schema).toDF(*docs.columns)
