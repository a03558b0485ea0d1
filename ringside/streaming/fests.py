"""A table of fests' bouts that batches replace in place, a few partitions at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ringside.operators.merging import replaced

BUCKETS = 64


def bucketed(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.hash(F.col("fest_id").cast("long")), F.lit(buckets)))


def _there(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def bout_table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The bouts of all fests; none before the first batch."""
    if not _there(spark, f"{folder}/table"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/table").drop("bucket")


def fest_replacer(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the batch's fests replace their earlier bouts; no other bucket's files are touched.

    What the touched buckets will hold is written to a stage of the batch first and then put in their place, by a dynamic
    overwrite. A batch that is repeated takes its finished stage again, since a crash while buckets were put in place may have
    left the table without them; so it ends as if it had run once. Stages of batches before the last are removed.
    """

    def stage(number: int) -> str:
        return f"{folder}/stage/{number}"

    def write(batch: DataFrame, number: int) -> None:
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        if not _there(spark, f"{stage(number)}/_SUCCESS"):
            new = bucketed(batch, buckets)
            touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
            if not touched:
                return
            old = spark.createDataFrame([], f"{schema}, bucket int")
            if _there(spark, f"{folder}/table"):
                old = spark.read.schema(f"{schema}, bucket int").parquet(f"{folder}/table").where(F.col("bucket").isin(touched))
            replaced(old, new, "fest_id").write.mode("overwrite").parquet(stage(number))
        ready = spark.read.schema(f"{schema}, bucket int").parquet(stage(number))
        ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{folder}/table")
        if number:
            path = spark._jvm.org.apache.hadoop.fs.Path(stage(number - 1))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    return write
