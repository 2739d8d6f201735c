"""An extension: the last known delay of each run from a stream of events, with event-time watermarks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_known_stream(events: DataFrame, late: str = "30 minutes", window: str = "1 hour") -> DataFrame:
    """run_id, window, time and delay of the last event in each window; events more than `late` behind are dropped.

    events: run_id, time (timestamp), index, is_arr, delay. Works on streams and on tables alike.
    """
    order = F.struct("time", "index", ~F.col("is_arr"))
    grouped = events.withWatermark("time", late).groupBy("run_id", F.window("time", window))
    return grouped.agg(F.max("time").alias("time"), F.max_by("delay", order).alias("delay"))
