"""The pipeline's stages: each on a few planted documents, and all of them on the smallest tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_in_order():
    assert [name for name, _ in P.STAGES] == ["language", "near_duplicates", "repeated_spans", "benchmark", "mixture"]


def test_language_drops_texts_without_letters(spark, data):
    docs = documents(spark, [(1, "the old house"), (2, "123 !"), (3, None), (5, "the new garden"), (6, "the")])
    assert {r.doc_id for r in P.language(spark, docs, data).collect()} == {1, 5, 6}


def test_language_drops_random_letters(spark, data):
    """Random letters go where there are enough of them to tell; short texts stay."""
    r = random.Random(1)
    junk = [(i, "".join(r.choice("абвгдежзийклмн ") for _ in range(200))) for i in range(100, 130)]
    docs = spark.read.parquet(f"{data}/documents.parquet").unionByName(documents(spark, [*junk, (131, "жзий"), (132, "qx")]).withColumn("lang", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 10**6))
    assert 9 * len(junk) < 10 * (docs.count() - P.language(spark, docs, data).count()) <= 11 * len(junk)
    kept = {x.doc_id - 10**6 for x in P.language(spark, docs, data).where("doc_id >= 1000000").collect()}
    assert {131, 132} <= kept and len(kept & {i for i, _ in junk}) <= 1


CLASHING = ("_row", "_places", "row", "places", "c0", "c1", "variety", "cosine", "kept", "spans", "n_words", "n_removed", "_gone", "id", "doc", "body", "keys", "lang_pred", "score", "rank", "size", "rows", "other_0", "carried_0", "note_doc")


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES[:-1]])
def test_stages_with_clashing_columns_repeated_rows_and_nulls(spark, data, name):
    stage = dict(P.STAGES)[name]
    words = " ".join(f"w{i}" for i in range(40))
    rows = [(1, "the old house and the garden"), (1, "the old house and the garden"), (5, "the new garden"), (6, "the end of it"), (None, "the old man"), (None, None), (7, words), (8, ""), (9, "x y")]
    plain = documents(spark, rows)
    extra = plain.withColumns({c: F.lit("x") for c in CLASHING}).withColumn("meta.url", F.lit("u")).withColumn("tags", F.create_map(F.lit("a"), F.lit("b")))
    got = stage(spark, extra, data)
    assert got.columns == extra.columns
    assert sorted(map(tuple, got.select(*COLUMNS).collect()), key=str) == sorted(map(tuple, stage(spark, plain, data).select(*COLUMNS).collect()), key=str)
    assert got.where("kept <> 'x'").count() == 0
    assert stage(spark, plain.where("doc_id = 99"), data).collect() == []
    assert stage(spark, plain.drop("n_chars"), data).columns == [c for c in COLUMNS if c != "n_chars"]


def test_language_drops_random_latin_letters_of_any_choice(spark, data):
    """Letters drawn evenly, from few or by frequency, with and without long texts; all clean documents stay."""
    r = random.Random(3)
    kinds = ["abcdefghijklmnopqrstuvwxyz ", "abcdefghijklmn ", "etaoinshrdlu ", "eeeeetttaaaooiinnsshhrrdlcumwfgypb     "]
    junk = [(10**6 + i, "".join(r.choice(kinds[i % 4]) for _ in range(r.randint(200, 900)))) for i in range(400)]
    docs = spark.read.parquet(f"{data.replace('0.001', '0.01')}/documents.parquet")
    kept = {x.doc_id for x in P.language(spark, docs.unionByName(documents(spark, junk).withColumn("lang", F.lit(None).cast("string"))), data).collect()}
    assert {x.doc_id for x in docs.where("text is not null").collect()} <= kept
    assert len([i for i, _ in junk if i in kept]) <= 8


def test_near_duplicates_keep_the_smallest(spark, data):
    words = [f"w{i}" for i in range(60)]
    docs = documents(spark, [(9, " ".join(words)), (4, " ".join(words[:-1] + ["x"])), (7, "something else"), (7, "something else"), (None, " ".join(words))])
    got = P.near_duplicates(spark, docs, data)
    assert sorted((r.doc_id for r in got.collect()), key=str) == [4, 7, None]
    assert got.columns == COLUMNS


def test_rows_that_repeat_an_id_with_another_text_are_judged_alone(spark, data):
    words = " ".join(f"w{i}" for i in range(60))
    docs = documents(spark, [(3, words), (5, words), (5, "another text stands here alone"), (6, "x y"), (6, "x y")])
    got = sorted((r.doc_id, r.text) for r in P.near_duplicates(spark, docs, data).collect())
    assert got == [(3, words), (5, "another text stands here alone"), (6, "x y")]
    cut = sorted((r.doc_id, r.text) for r in P.repeated_spans(spark, docs, data).collect())
    assert cut == [(3, words), (5, "another text stands here alone"), (6, "x y"), (6, "x y")]


def test_benchmark_on_the_shuffled_path_keeps_columns(spark, data, monkeypatch):
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(r.text.split()) > 15)
    docs = documents(spark, [(1, "clean words"), (2, f"x {item} y"), (3, None), (None, item)]).withColumns({"_row": F.lit(7), "_places": F.lit(8), "row": F.lit(9), "meta.url": F.lit("u"), "tags": F.create_map(F.lit("a"), F.lit("b"))})
    wide = P.decontaminate.without_contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet"))
    shuffled = P.decontaminate.without_contaminated(docs, spark.read.parquet(f"{data}/benchmark.parquet"), broadcast_windows=0)
    assert wide.columns == shuffled.columns == docs.columns
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert rows(wide) == rows(shuffled) and {r[0] for r in rows(shuffled)} == {1, 3} and all(r[5:8] == (7, 8, 9) for r in rows(shuffled))


def test_repeated_spans_are_cut(spark, data):
    span = " ".join(f"w{i}" for i in range(20))
    got = {r.doc_id: r for r in P.repeated_spans(spark, documents(spark, [(1, f"a  {span}\nb"), (2, f"c {span} d"), (3, span), (4, "")]), data).collect()}
    assert (got[1].text, got[2].text, got[2].n_chars) == (f"a  {span}\nb", "c d", 3)
    assert set(got) == {1, 2, 4}


def test_benchmark_documents_go(spark, data):
    item = next(r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect() if len(r.text.split()) > 15)
    got = P.benchmark(spark, documents(spark, [(1, "clean words"), (2, f"x {item} y"), (3, None)]), data)
    assert {r.doc_id for r in got.collect()} == {1, 3}


def test_whole_pipeline(spark, data):
    out = P.run(spark, data)
    assert out.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = out.collect()
    assert 100 < len(rows) <= 200
    assert all(r.taken <= 3 * r["size"] for r in rows)
