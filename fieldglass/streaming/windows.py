"""Event-time windows over a stream of samples, and the rows that came too late for them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fieldglass.operators.signal import HOP_SECONDS
from fieldglass.streaming.stages import with_event_time


def windowed_energy(
    samples: DataFrame, keys: Sequence[str], time: str, value: str, width: float = HOP_SECONDS, hop: float | None = None,
    delay: str = "5 seconds",
) -> DataFrame:
    """(keys, start, end, n, rms) per event-time window: tumbling, or sliding by `hop` seconds.

    A window is released once, when the watermark has passed its end; its state is a count and a sum.
    Windows are aligned to second 0 and cover [start, end) in whole milliseconds. A null value counts
    in no window, a null time neither.
    """
    length, step = (f"{round(1000 * x)} milliseconds" for x in (width, hop or width))
    timed = with_event_time(samples.where(F.col(value).isNotNull()), time, delay)
    sums = timed.groupBy(F.window("event_time", length, step).alias("_window"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(value) * F.col(value)).alias("_energy"))
    seconds = lambda edge: F.unix_millis(F.col(f"_window.{edge}")) / 1000.0
    return sums.select(*keys, seconds("start").alias("start"), seconds("end").alias("end"), "n", F.sqrt(F.col("_energy") / F.col("n")).alias("rms"))


def late_rows(query: StreamingQuery) -> int:
    """Rows of the query's recent batches that came behind the watermark and were left out."""
    return sum(
        operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
