"""Two records of a bout become one: merging, checking and warning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIRROR = {"+": "o", "-": "-", "o": "+"}
OUTCOME = {"+": "win_a", "-": "draw", "o": "win_b"}


def _mapped(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def merged(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """One row per fest and pair, with each side's last record: symbol, note and wreath of a (smaller id) and b.

    ``order`` says which record of a side is the last: by default the column ``seq`` (a record's place in its source) where
    there is one, else the larger note and symbol. A self-bout has one side.
    """
    a, b = F.least("athlete_id", "opponent_id"), F.greatest("athlete_id", "opponent_id")
    if order is None:
        order = F.struct(*(("seq",) if "seq" in entries.columns else ()), "note", "symbol", "wreath")
    record = F.struct("symbol", "note", "wreath")
    low = F.col("athlete_id") <= F.col("opponent_id")
    high = F.col("athlete_id") >= F.col("opponent_id")
    grouped = entries.groupBy("fest_id", a.alias("a_id"), b.alias("b_id")).agg(
        F.min("datum").alias("datum"), F.min("tier").alias("tier"), F.max_by(F.when(low, record), F.when(low, order)).alias("low"), F.max_by(F.when(high, record), F.when(high, order)).alias("high")
    )
    valid = lambda s: F.col(s).isNull() | _mapped(MIRROR, F.col(f"{s}.symbol")).isNotNull()
    fits = F.col("low").isNull() | F.col("high").isNull() | (_mapped(MIRROR, F.col("low.symbol")) == F.col("high.symbol"))
    seen = F.when(F.col("low").isNull(), "high only").when(F.col("high").isNull(), "low only").otherwise("both")
    problem = F.when(~valid("low") | ~valid("high"), "unknown symbol").when(~fits, "contradiction").when(seen != "both", seen)
    symbol = F.coalesce("low.symbol", _mapped(MIRROR, F.col("high.symbol")))
    return grouped.select(
        "fest_id", "datum", "tier", "a_id", "b_id",
        _mapped(OUTCOME, symbol).alias("outcome"),
        F.col("low.note").alias("note_a"), F.col("high.note").alias("note_b"),
        F.coalesce("low.wreath", F.lit(False)).alias("wreath_a"), F.coalesce("high.wreath", F.lit(False)).alias("wreath_b"),
        problem.alias("problem"),
    )


def deduplicated(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """Bouts whose records agree, or that one side recorded alone."""
    return merged(entries, order).where("problem is null or problem in ('high only', 'low only')").drop("problem")


def warnings(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """Bouts that were dropped (contradiction, unknown symbol) or rest on one record."""
    return merged(entries, order).where("problem is not null").select("fest_id", "a_id", "b_id", "problem")


def points_mismatches(notes: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """From owner, note, total: owners whose notes don't add up to their declared total."""
    summed = notes.groupBy("owner").agg(F.round(F.sum("note"), 2).alias("summed"), F.max("total").alias("total"))
    return summed.where(F.abs(F.col("summed") - F.col("total")) > tolerance)
