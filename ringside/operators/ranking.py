"""Places in an order of a whole table, without one task that sorts it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ringside.sources.scratch import written


def placed(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``rows`` with their place from 1 on (a long), in an order without ties (or in which ties may change places).

    Spark deals ranges of the order and sorts inside each; only the numbers of rows of the ranges are summed in one task.
    A range is a partition, so the dealt rows are written once for both uses: a second deal may cut elsewhere.
    """
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    dealt = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_range"), at.alias("_at")), "placed")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return dealt.join(F.broadcast(starts), "_range").withColumn(name, F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
