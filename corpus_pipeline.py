"""A corpus from raw documents to a mixture: five stages, each written and read again before the next.

1. language: documents without a letter go, and those of many different trigrams that are like no language learned, or no
   more like one than their own letters in random order (``language_id.known_language``); short texts with letters stay.
2. near_duplicates: of every group that links of 75 % shingle similarity connect, the smallest doc_id stays.
3. repeated_spans: words inside a 13-word window that an earlier document holds are taken out; documents that lose all
   their words go. Texts that lose nothing stay as they are.
4. benchmark: documents that hold a 10-word window of a benchmark item go.
5. mixture: the words that the mix takes of each document.

Every stage but the last returns the columns of documents, in their order, for a part of its rows. A row with a null
doc_id is kept by stages 1 to 4 if its text is (it can be nobody's duplicate); rows that repeat a doc_id with another text
are documents of their own. Further columns may have any names; n_chars,
where there is one, is counted anew for texts that stage 3 changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.llm import debruijn_dedup, decontaminate, jaccard_join, language_id, mixture
from ringside.llm.rows import named_again, told_apart, without_ids
from ringside.llm.session import written

def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, ids = told_apart(docs)
    groups = jaccard_join.jaccard_components(own)
    return named_again(without_ids(own, groups.where("component_id <> doc_id").select("doc_id")), ids, "doc_id")


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    others = {c: f"other_{i}" for i, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    named = docs.select("doc_id", "text", *(F.col("`" + c.replace("`", "``") + "`").alias(n) for c, n in others.items()))
    out = debruijn_dedup.remove_repeated_words(named, as_is=True, carry=tuple(others.values())).where("n_removed < n_words or n_words = 0")
    values = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(n) for c, n in others.items()}
    if "n_chars" in others:
        values["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col(others["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return out.select(*(values[c].alias(c) for c in docs.columns))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixture.mix(docs).taken


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_spans", repeated_spans),
    ("benchmark", benchmark),
    ("mixture", mixed),
]
#: SQL can't say stage 1 (learned prototypes); stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
