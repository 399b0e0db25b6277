"""Sampling of frames and pairing of frames a gap apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import sampling_step


def sampled(frames: DataFrame, target_fps: float, max_seconds: float | None = None, default_fps: float = 30.0) -> DataFrame:
    """Frames at multiples of the step, with sampled_index from 0 and timestamp_sec; the bound on seconds is inclusive.

    frame_idx counts from 0 without gaps, so that the index is a quotient and needs no sort."""
    fps = F.when(F.col("native_fps") > 0, F.col("native_fps")).otherwise(F.lit(default_fps))
    step = sampling_step(fps, F.lit(target_fps))
    out = frames.where(F.col("frame_idx") % step == 0).withColumns({"sampled_index": (F.col("frame_idx") / step).cast("int"), "timestamp_sec": F.col("frame_idx") / fps})
    return out if max_seconds is None else out.where(F.col("timestamp_sec") <= max_seconds)


def renumbered(frames: DataFrame, stretch: int = 1 << 16) -> DataFrame:
    """sampled_index by position, for frames that were picked otherwise.

    Frames are ranked within stretches of their numbers, on top of a running total of the stretches before: no task sorts a video."""
    part = F.floor(F.col("frame_idx") / stretch)
    sizes = frames.groupBy("video_id", part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("video_id", "part", (F.sum("n").over(Window.partitionBy("video_id").orderBy("part")) - F.col("n")).alias("before"))
    ranked = frames.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("video_id", "part").orderBy("frame_idx")))
    return ranked.join(before, ["video_id", "part"]).withColumn("sampled_index", (F.col("rank") + F.col("before") - 1).cast("int")).drop("part", "rank", "before")


def short_videos(frames: DataFrame, least: int = 8) -> DataFrame:
    """Videos with fewer frames than needed, with their number."""
    return frames.groupBy("video_id").agg(F.count("*").alias("n_frames")).where(F.col("n_frames") < least)


def long_enough(frames: DataFrame, least: int = 8) -> DataFrame:
    """The same frames; the job fails with the name of a video that has fewer than `least`. Sizes are partial aggregates that go back by a join."""
    sizes = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    checked = sizes.where(F.when(F.col("n_frames") >= least, True).otherwise(F.raise_error(F.concat(F.lit("too few frames in "), "video_id")).cast("boolean")))
    return frames.join(checked.select("video_id"), "video_id")


def gap_pairs(frames: DataFrame, gaps: tuple[int, ...], carried: tuple[str, ...] = ("frame_idx", "timestamp_sec")) -> DataFrame:
    """Each frame with the one `gap` samples before it: an equi-join on (video_id, index), for all gaps at once."""
    curr = frames.select("video_id", "sampled_index", *carried, F.explode(F.array(*map(F.lit, gaps))).alias("gap")).withColumn("prev_index", F.col("sampled_index") - F.col("gap"))
    prev = frames.select("video_id", F.col("sampled_index").alias("prev_index"), *(F.col(c).alias(f"{c}_prev") for c in carried))
    return curr.join(prev, ["video_id", "prev_index"]).select("video_id", "gap", F.col("sampled_index").alias("sampled_index_curr"), *(F.col(c).alias(f"{c}_curr") for c in carried), F.col("prev_index").alias("sampled_index_prev"), *(f"{c}_prev" for c in carried))


def overlay_frames(overlays: DataFrame, frame_meta: DataFrame) -> DataFrame:
    """Overlays with the sampled frame of their map index; those without a frame go."""
    return overlays.join(frame_meta.select("video_id", "t", "sampled_index_curr"), ["video_id", "t"])
