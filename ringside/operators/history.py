"""What was known before a bout: windows over each athlete's or pair's earlier bouts.

Order within an athlete's history is (datum, fest_id, a_id, b_id) everywhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.functions.rating import shrunk_record

ORDER = ("datum", "fest_id", "a_id", "b_id")
FORM_BOUTS = 5


def with_history(sides: DataFrame, form_bouts: int = FORM_BOUTS) -> DataFrame:
    """n_pre (earlier bouts) and form_pre (mean points of the last five, 0.5 without any): one shuffle for both."""
    own = Window.partitionBy("athlete_id").orderBy(*ORDER)
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    recent = own.rowsBetween(-form_bouts, -1)
    return sides.withColumn("n_pre", F.count(F.lit(1)).over(before)).withColumn("form_pre", F.coalesce(F.avg("s").over(recent), F.lit(0.5)))


def current_form(sides: DataFrame, form_bouts: int = FORM_BOUTS) -> DataFrame:
    """athlete_id, form after all bouts, and the number of bouts."""
    last = Window.partitionBy("athlete_id").orderBy(*(F.desc(c) for c in ORDER))
    numbered = sides.select("athlete_id", "s", F.row_number().over(last).alias("k"))
    return numbered.groupBy("athlete_id").agg(F.avg(F.when(F.col("k") <= form_bouts, F.col("s"))).alias("form"), F.count(F.lit(1)).alias("n"))


def with_head_to_head(bouts: DataFrame) -> DataFrame:
    """h2h_a: the shrunk record of a against b before each bout; b's is its negative."""
    points = F.when(F.col("outcome") == "win_a", 1.0).when(F.col("outcome") == "draw", 0.5).otherwise(0.0)
    before = Window.partitionBy("a_id", "b_id").orderBy("datum", "fest_id").rowsBetween(Window.unboundedPreceding, -1)
    return bouts.withColumn("h2h_a", shrunk_record(F.sum(points).over(before), F.count(F.lit(1)).over(before)))


def head_to_head(bouts: DataFrame) -> DataFrame:
    """Wins of a, draws and wins of b for every pair that met."""
    return bouts.groupBy("a_id", "b_id").agg(*(F.count_if(F.col("outcome") == o).alias(n) for o, n in (("win_a", "wins_a"), ("draw", "draws"), ("win_b", "wins_b"))))


def records(sides: DataFrame) -> DataFrame:
    """athlete_id, opponent_id, record: each athlete's shrunk record against each opponent after all bouts."""
    met = sides.groupBy("athlete_id", "opponent_id").agg(F.sum("s").alias("p"), F.count(F.lit(1)).alias("n"))
    return met.select("athlete_id", "opponent_id", shrunk_record(F.col("p"), F.col("n")).alias("record"))


def meetings(bouts: DataFrame, one: int, two: int) -> DataFrame:
    """The bouts of two athletes, the latest first, from the view of ``one``; none if they never met."""
    a, b = min(one, two), max(one, two)
    flip = {"win_a": "win_b", "win_b": "win_a"}
    result = F.col("outcome") if one == a else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in flip.items() for x in p)), F.col("outcome")), F.col("outcome"))
    return bouts.where((F.col("a_id") == a) & (F.col("b_id") == b)).select("datum", "fest_id", result.alias("outcome")).orderBy(F.desc("datum"), F.desc("fest_id"))


def listed_meetings(bouts: DataFrame, fests: DataFrame) -> DataFrame:
    """Every bout with its fest (fest_id, fest, datum) and its place k in the pair's list, the latest first.

    A fest that nobody knows leaves its name and date null; such bouts come last. Bouts of one day go by fest_id.
    """
    told = bouts.select("a_id", "b_id", "fest_id", "outcome").join(fests.select("fest_id", "fest", "datum"), "fest_id", "left")
    newest = Window.partitionBy("a_id", "b_id").orderBy(F.desc_nulls_last("datum"), F.desc("fest_id"))
    return told.withColumn("k", F.row_number().over(newest))


def wreaths(bouts: DataFrame) -> DataFrame:
    """Fests at which an athlete won a wreath, from deduplicated bouts."""
    both = F.array(F.struct(F.col("a_id").alias("athlete_id"), F.col("wreath_a").alias("wreath")), F.struct(F.col("b_id").alias("athlete_id"), F.col("wreath_b").alias("wreath")))
    held = bouts.select("fest_id", F.explode(both).alias("r")).where("r.wreath").select("fest_id", "r.athlete_id")
    return held.groupBy("athlete_id").agg(F.count_distinct("fest_id").alias("wreaths"))
