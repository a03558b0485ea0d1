"""Statistics of associations, their roll-up to regions, and classes for maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringside.operators.ranking import placed

COUNTS = ("athletes", "metric_sum", "n_top", "wins", "draws", "losses")

# The cantons of each local association.
CANTONS = {
    "Berner-Jura": ["Bern"], "Emmental": ["Bern"], "Mittelland": ["Bern"], "Oberaargau": ["Bern"], "Oberland": ["Bern"], "Seeland": ["Bern"],
    "Luzern": ["Luzern"], "Ob- und Nidwalden": ["Obwalden", "Nidwalden"], "Schwyz": ["Schwyz"], "Tessin": ["Ticino"], "Uri": ["Uri"], "Zug": ["Zug"],
    "Appenzell": ["Appenzell Ausserrhoden", "Appenzell Innerrhoden"], "Glarus": ["Glarus"], "Graubünden": ["Graubünden"], "Schaffhausen": ["Schaffhausen"],
    "St. Gallen": ["St. Gallen"], "Thurgau": ["Thurgau"], "Zürich": ["Zürich"],
    "Aargau": ["Aargau"], "Baselland": ["Basel-Landschaft"], "Basel-Stadt": ["Basel-Stadt"], "Solothurn": ["Solothurn"],
    "Fribourgeoise": ["Fribourg"], "Genevoise": ["Genève"], "Jura": ["Jura"], "Neuchâteloise": ["Neuchâtel"], "Vaudoise": ["Vaud"], "Valaisanne": ["Valais"],
}


def cantons(association: Column) -> Column:
    table = F.create_map(*(x for name, cs in CANTONS.items() for x in (F.lit(name), F.array(*map(F.lit, cs)))))
    return F.coalesce(F.try_element_at(table, association), F.array().cast("array<string>"))


def top_threshold(athletes: DataFrame, metric: str) -> DataFrame:
    """The 90th percentile (linear) of the metric over all athletes, or the maximum of fewer than ten."""
    return athletes.agg(F.when(F.count(metric) >= 10, F.percentile(metric, 0.9)).otherwise(F.max(metric)).alias("threshold"))


def association_stats(athletes: DataFrame, sides: DataFrame, metric: str) -> DataFrame:
    """Per association: athletes, sum of the metric, athletes at the threshold or above, and results of their bouts.

    ``athletes`` has athlete_id, association and the metric. Athletes without association count for the threshold only.
    """
    threshold = top_threshold(athletes, metric).withColumnRenamed("threshold", "_threshold")
    own = athletes.where("association is not null and association <> ''")
    judged = own.select("association", metric).join(F.broadcast(threshold))  # one row
    people = judged.groupBy("association").agg(F.count(F.lit(1)).alias("athletes"), F.sum(metric).alias("metric_sum"), F.count_if(F.col(metric) >= F.col("_threshold")).alias("n_top"))
    results = sides.groupBy("athlete_id").agg(*(F.count_if(F.col("s") == v).alias(n) for n, v in (("wins", 1.0), ("draws", 0.5), ("losses", 0.0))))
    bouts = own.join(results, "athlete_id").groupBy("association").agg(*(F.sum(c).alias(c) for c in ("wins", "draws", "losses")))
    joined = people.join(bouts, "association", "left")
    return joined.select("association", "athletes", "metric_sum", "n_top", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("wins", "draws", "losses")))


def rolled_up(stats: DataFrame, regions: Column) -> DataFrame:
    """Statistics of regions: an association's are split evenly over its regions, then rounded half to even."""
    spread = stats.withColumn("regions", regions).withColumn("region", F.explode("regions"))
    return spread.groupBy("region").agg(*(F.bround(F.sum(F.col(c) / F.size("regions")), 0).cast("long").alias(c) for c in COUNTS))


def map_metrics(stats: DataFrame) -> DataFrame:
    """Share of wins, and of top athletes; null where there is nothing to share."""
    return stats.withColumn("win_share", F.try_divide("wins", F.col("wins") + F.col("draws") + F.col("losses"))).withColumn("top_share", F.try_divide("n_top", "athletes"))


def quantile_bounds(values: DataFrame, value: str, classes: int) -> DataFrame:
    """Distinct upper class bounds: the values at floor(i / classes * (n - 1)) of the sorted values, i = 1 .. classes - 1.

    Exact by rank, which ranges of the values are counted for; only the chosen ranks are gathered.
    """
    ranked = placed(values.where(F.col(value).isNotNull()).select(F.col(value).alias("v")), [F.col("v")], "k")
    total = ranked.agg(F.count(F.lit(1)).alias("n"))
    wanted = total.select(F.explode(F.array(*(F.floor(F.lit(i) / classes * (F.col("n") - 1)) + 1 for i in range(1, classes)))).alias("k"))
    return ranked.join(F.broadcast(wanted.distinct()), "k").agg(F.array_sort(F.collect_set("v")).alias("bounds"))  # as many rows as classes


def class_of(value: Column, bounds: Column) -> Column:
    """How many bounds a value exceeds."""
    return F.size(F.filter(bounds, lambda b: value > b))


def map_areas(regions: DataFrame, associations: DataFrame, split: str) -> DataFrame:
    """Regions without ``split``, and in its place its associations."""
    return regions.where(F.col("name") != split).unionByName(associations.where(F.col("region") == split).select("name", "wins"))
