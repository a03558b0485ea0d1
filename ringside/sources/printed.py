"""Printed statistics: words with coordinates become lines, blocks of athletes, and their bouts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Where the printed columns begin and end.
COLUMNS = ((0.0, 200.0), (200.0, 380.0), (380.0, 600.0))
TOLERANCE = 3.0


def lines(words: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """From doc, page, text, x0, top: doc, col, page, line, tokens. Words outside all columns are left out.

    A word belongs to the line whose first word is at most ``tolerance`` away in height: a fold over the words in order,
    since it is the line's first word that counts, not the word before.
    """
    col = F.lit(None).cast("int")
    for i, (low, high) in enumerate(COLUMNS):
        col = F.when((F.col("x0") >= low) & (F.col("x0") < high), i).otherwise(col)
    placed = words.withColumn("col", col).where("col is not null")
    ordered = placed.groupBy("doc", "page", "col").agg(F.array_sort(F.collect_list(F.struct("top", "x0", "text"))).alias("words"))
    start = F.struct(F.lit(-1).alias("line"), F.lit(float("-inf")).alias("anchor"), F.array().cast("array<struct<line:int,x0:double,text:string>>").alias("out"))

    def add(state, word):  # noqa: ANN001, ANN202
        fresh = F.abs(word["top"] - state["anchor"]) > tolerance
        line = F.when(fresh, state["line"] + 1).otherwise(state["line"])
        placed = F.struct(line.alias("line"), word["x0"].cast("double").alias("x0"), word["text"].alias("text"))
        return F.struct(line.alias("line"), F.when(fresh, word["top"].cast("double")).otherwise(state["anchor"]).alias("anchor"), F.concat(state["out"], F.array(placed)).alias("out"))

    folded = ordered.select("doc", "page", "col", F.explode(F.aggregate("words", start, add, lambda s: s["out"])).alias("w"))
    grouped = folded.groupBy("doc", "col", "page", F.col("w.line").alias("line")).agg(F.array_sort(F.collect_list(F.struct("w.x0", "w.text"))).alias("t"))
    return grouped.select("doc", "col", "page", "line", F.transform("t", lambda t: t["text"]).alias("tokens"))


def _blocks(words: DataFrame) -> DataFrame:
    """Lines with what they say: header, name, note, stars, and the number of their block in the column."""
    first, rest = F.col("tokens")[0], F.expr("slice(tokens, 2, greatest(size(tokens) - 1, 0))")
    last = lambda t: F.element_at(t, -1)
    without = lambda t: F.slice(t, F.lit(1), F.size(t) - 1)
    note, stars = r"^\d{1,2}\.\d{2}$", r"^\*{1,3}$"
    rows = lines(words).withColumn("first", first).withColumn("header", F.col("first").rlike(r"^\d+[a-z]?$") & (F.size("tokens") >= 2)).withColumn("rest", rest)
    noted = (F.size("rest") > 0) & last(F.col("rest")).rlike(note)
    rows = rows.withColumn("note", F.when(noted, last(F.col("rest")).cast("double"))).withColumn("rest", F.when(noted, without(F.col("rest"))).otherwise(F.col("rest")))
    starred = (F.size("rest") > 0) & last(F.col("rest")).rlike(stars)
    rows = rows.withColumn("stars", starred).withColumn("rest", F.when(starred, without(F.col("rest"))).otherwise(F.col("rest"))).withColumn("name", F.array_join("rest", " "))
    down = Window.partitionBy("doc", "col").orderBy("page", "line")
    return rows.withColumn("block", F.sum(F.col("header").cast("int")).over(down))


def printed_names(words: DataFrame) -> DataFrame:
    """doc, name: the athletes whose blocks a document holds, each once; blocks without a name have none."""
    return _blocks(words).where("header and name <> ''").select("doc", "name").distinct()


def printed_bouts(words: DataFrame) -> DataFrame:
    """doc, block, name, total, wreath, symbol, opponent, note: the bouts of every athlete's block, columns left to right.

    A block begins with a line of rank and name; bouts before the first one, or after one without a name, are dropped.
    """
    rows = _blocks(words)
    heads = rows.where("header and name <> ''").select("doc", "col", "block", F.col("name").alias("athlete"), F.col("note").alias("total"), F.col("stars").alias("wreath"))
    bouts = rows.where("not header and name <> ''").where(F.col("first").rlike(r"^[+\-o]$")).select("doc", "col", "block", "page", "line", F.col("first").alias("symbol"), F.col("name").alias("opponent"), "note")
    return bouts.join(heads, ["doc", "col", "block"])
