"""Hysteresis events of each cell, as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite


def hysteresis_events(cells: DataFrame, tau_high: float = 0.7, tau_low: float = 0.4, max_gap: int = 0, value: str = "v") -> DataFrame:
    """video_id, y, x, t0, t1. An event starts at the first value of tau_high or more, ends at the last of tau_low or more,
    and bridges `max_gap` frames below; values that are not finite count as below."""
    if tau_low > tau_high or max_gap < 0:
        raise ValueError("tau_low must not exceed tau_high, and max_gap must not be negative")
    v = F.col(value).cast("double")
    support = cells.where(finite(v) & (v >= tau_low)).select("video_id", "y", "x", "t", (v >= tau_high).alias("trigger"))
    order = Window.partitionBy("video_id", "y", "x").orderBy("t")
    fresh = F.coalesce((F.col("t") - F.lag("t").over(order) > max_gap + 1).cast("int"), F.lit(1))
    islands = support.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    found = islands.groupBy("video_id", "y", "x", "island").agg(F.min(F.when(F.col("trigger"), F.col("t"))).alias("t0"), F.max("t").alias("t1"))
    return found.where(F.col("t0").isNotNull()).drop("island")


def numbered(events: DataFrame) -> DataFrame:
    """Adds event_id: the rank by (y, x, t0) within the video, from 1.

    A rank within (video, y) and a running total over the rows y give it, so that a video is not sorted in one task."""
    within = Window.partitionBy("video_id", "y").orderBy("x", "t0")
    before = events.groupBy("video_id", "y").agg(F.count("*").alias("n")).select("video_id", "y", (F.sum("n").over(Window.partitionBy("video_id").orderBy("y")) - F.col("n")).alias("before"))
    return events.withColumn("rank", F.row_number().over(within)).join(before, ["video_id", "y"]).withColumn("event_id", (F.col("rank") + F.col("before")).cast("int")).drop("rank", "before")


def block_events(cells: DataFrame, tau_high: float = 0.7, tau_low: float = 0.4, max_gap: int = 0, least: int = 3, value: str = "v") -> DataFrame:
    """Events of `least` frames or more; ids count the shorter ones too."""
    events = numbered(hysteresis_events(cells, tau_high, tau_low, max_gap, value)).withColumn("duration", F.col("t1") - F.col("t0") + 1)
    return events.where(F.col("duration") >= least).select("video_id", "event_id", "y", "x", "t0", "t1", "duration")
