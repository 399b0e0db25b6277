"""Hysteresis events over a stream of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import finite


def stream_events(cells: DataFrame, tau_high: float = 0.7, tau_low: float = 0.4, max_gap: int = 0, delay: str = "5 seconds", value: str = "v") -> DataFrame:
    """video_id, y, x, t0, t1 of the events of cells whose frame t is the second `ts` = timestamp_seconds(t).

    A session of supporting frames ends after max_gap missing ones, which is the batch rule; it is emitted once the
    watermark has passed it. Frames that come later than `delay` are dropped by the watermark."""
    v = F.col(value).cast("double")
    support = cells.where(finite(v) & (v >= tau_low)).withWatermark("ts", delay)
    t = F.unix_timestamp("ts").cast("int")
    found = support.groupBy("video_id", "y", "x", F.session_window("ts", f"{max_gap + 1} seconds 500 milliseconds")).agg(F.min(F.when(v >= tau_high, t)).alias("t0"), F.max(t).alias("t1"))
    return found.where(F.col("t0").isNotNull()).select("video_id", "y", "x", "t0", "t1")
