"""Folders for tables between steps: below the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a temporary folder only where it is unset and one machine does all."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir", None)
    known = context._jsc.sc().getCheckpointDir()
    if shared is None and known.isEmpty():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ringside-"))
        known = context._jsc.sc().getCheckpointDir()
    return f"{(shared or known.get()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back, for several uses."""
    path = folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
