"""Results as they come: late copies dropped, reloaded fests replaced, and form kept per athlete."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ringside.operators.merging import replaced

FORM = "athlete_id long, datum timestamp, form_pre double, n_pre long"
STATE = "last array<double>, n long"
RECENT = 5


def unrepeated(results: DataFrame, late: str = "30 days") -> DataFrame:
    """A stream of bouts without the copies that arrive again within the watermark."""
    return results.withWatermark("datum", late).dropDuplicatesWithinWatermark(["fest_id", "a_id", "b_id"])


def seasonal_counts(results: DataFrame, window: str = "30 days", late: str = "30 days") -> DataFrame:
    """Bouts and draws of every window of a stream; a window closes once the watermark has passed it."""
    grouped = results.withWatermark("datum", late).groupBy(F.window("datum", window))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("outcome") == "draw").alias("draws")).select("window.start", "window.end", "n", "draws")


def _form(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    last, n = state.get if state.exists else ([], 0)
    last = list(last)
    out = []
    # A micro-batch may bring a key in several frames; only all of them together can be put in order.
    for datum, s in pd.concat(batches).sort_values(["datum", "fest_id"])[["datum", "s"]].itertuples(index=False):
        out.append((key[0], datum, sum(last) / len(last) if last else 0.5, n))
        last, n = [*last, float(s)][-RECENT:], n + 1
    yield pd.DataFrame(out, columns=["athlete_id", "datum", "form_pre", "n_pre"])
    state.update((last, n))


def running_form(sides: DataFrame) -> DataFrame:
    """Form and experience before each bout of a stream: five numbers of state per athlete.

    Inside a micro-batch bouts are put in order of date and fest. A bout that arrives in a later micro-batch than bouts
    after it counts when it arrives: its own form includes theirs, and rows already given stay as they are.
    """
    return sides.groupBy("athlete_id").applyInPandasWithState(_form, FORM, STATE, "append", GroupStateTimeout.NoTimeout)


def fest_writer(spark: SparkSession, folder: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a table of bouts in which a batch's fests replace their earlier version.

    Each batch writes a new version beside the last one; writing a batch again writes the same version again.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch
        if number:
            new = replaced(spark.read.schema(batch.schema).parquet(f"{folder}/v{number - 1}"), batch, "fest_id")
        new.write.mode("overwrite").parquet(f"{folder}/v{number}")

    return write
