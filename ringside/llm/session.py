"""Where intermediate tables go, and how work is cut into bounded pieces."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; a temporary one only where it is unset and one machine does all."""
    jsc = spark.sparkContext._jsc.sc()
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None and jsc.getCheckpointDir().isEmpty() and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if jsc.getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="ringside-ckpt-"))
    return named or jsc.getCheckpointDir().get()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a written table inside the shared checkpoint folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: short lineage that survives lost executors.

    Zstandard works in the heap; Spark's default codec keeps buffers outside it, as long as the longest values, until a collection.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def rewritten(df: DataFrame, name: str, old: DataFrame | None = None) -> DataFrame:
    """As ``written``; the written table ``old`` that ``df`` was made from, and nothing else needs, is removed."""
    new = written(df, name)
    for path in old.inputFiles()[:1] if old is not None else ():
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path).getParent()
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return new


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(rows: DataFrame, order: str | list[str], name: str) -> DataFrame:
    """``rows`` with their place from 0 on, in an order without ties: dealt by ranges, written, and the ranges' sizes summed."""
    order = [order] if isinstance(order, str) else order
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return dealt.join(starts, "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def bucket_bits(docs: DataFrame, text: str = "text", bytes_per_bucket: int = 2 << 20) -> int:
    """log2 of the number of hash buckets, so that one bucket holds the keys of about ``bytes_per_bucket`` of text.

    Counted over the whole table; it changes how the work is cut, never the result.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    return min(24, max(5, (int(size) // bytes_per_bucket).bit_length()))


def small_batches(spark: SparkSession, rows: int = 1024) -> None:
    """Keep an Arrow batch of texts or packed arrays to a few MB (rows are counted, not bytes, by default)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
