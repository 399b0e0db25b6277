"""Windows over the frames of a cell: persistence gate, means and alignment. Frames must be dense (see `densify`)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import magnitude

CELL = ("video_id", "gap", "y", "x")


def _cell(df: DataFrame) -> list[str]:
    return [c for c in CELL if c in df.columns]


def centred(df: DataFrame, width: int):
    """The window of `width` frames around each, cut at the ends of the series."""
    return Window.partitionBy(*_cell(df)).orderBy("t").rowsBetween(-((width - 1) // 2), width // 2)


def densify(cells: DataFrame, frames: DataFrame, values: list[str]) -> DataFrame:
    """A row for every cell and frame, with 0 where there is none. `frames` has video_id and t."""
    keys = _cell(cells)
    grid = cells.select(*keys).distinct().join(frames.select("video_id", "t").distinct(), "video_id")
    return grid.join(cells, [*keys, "t"], "left").select(*keys, "t", *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def running_sum(df: DataFrame, value: str) -> DataFrame:
    """Prefix sums in double precision, the frame's own value included."""
    over = Window.partitionBy(*_cell(df)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(f"sum_{value}", F.sum(F.col(value).cast("double")).over(over))


def _length(u: Column, v: Column) -> Column:
    return magnitude(u.cast("double"), v.cast("double")).cast("float").cast("double")


def persistence(df: DataFrame, width: int = 15, eps: float = 1e-12) -> Column:
    """Length of the summed vectors over the sum of their lengths, 0 to 1; 0 if there is no motion."""
    over = centred(df, width)
    return _share(*(F.sum(c).over(over) for c in (F.col("u").cast("double"), F.col("v").cast("double"), _length(F.col("u"), F.col("v")))), eps)


def _share(u: Column, v: Column, total: Column, eps: float = 1e-12) -> Column:
    resultant = F.hypot(u, v).cast("float").cast("double")
    return F.when(total > eps, F.greatest(F.lit(0.0), F.least(F.lit(1.0), resultant / total))).otherwise(0.0).cast("float")


def gate(df: DataFrame, width: int = 15, least: float = 0.85) -> DataFrame:
    """Adds p15 and keep; rejected vectors become zero and still count in later means."""
    out = df.withColumn("p15", persistence(df, width))
    keep = F.col("p15").cast("double") >= least
    return out.withColumns({"keep": keep, "u": F.when(keep, F.col("u")).otherwise(F.lit(0.0)), "v": F.when(keep, F.col("v")).otherwise(F.lit(0.0))})


def moving_mean(df: DataFrame, radius: int = 2) -> DataFrame:
    """Mean vector of the frames within the radius that exist."""
    if radius <= 0:
        return df
    over = Window.partitionBy(*_cell(df)).orderBy("t").rowsBetween(-radius, radius)
    return df.withColumns({c: F.avg(F.col(c).cast("double")).over(over).cast("float") for c in ("u", "v")})


def gated_mean(df: DataFrame, width: int = 15, least: float = 0.85, radius: int = 2) -> DataFrame:
    """Gate, mean and the magnitude of the mean; one sort serves both windows."""
    out = moving_mean(gate(df, width, least), radius)
    return out.withColumn("m", magnitude(F.col("u").cast("double"), F.col("v").cast("double")).cast("float"))


def weighted_moving_mean(df: DataFrame, radius: int) -> DataFrame:
    """Sums of weighted components over the sum of weights within the radius, 0 where that is 0. Needs wu, wv, w."""
    over = Window.partitionBy(*_cell(df)).orderBy("t").rowsBetween(-radius, radius)
    weight = F.sum("w").over(over)
    return df.withColumns({c: F.when(weight > 0, F.sum(f"w{c}").over(over) / weight).otherwise(0.0) for c in ("u", "v")})


def series(frames: DataFrame) -> DataFrame:
    """video_id, first, last: the frames of each video, all of which exist."""
    return frames.groupBy("video_id").agg(F.min("t").alias("first"), F.max("t").alias("last"))


def reached(cells: DataFrame, frames: DataFrame, before: int, after: int) -> DataFrame:
    """`cells` with first and last of their series, once for each frame `at` whose window of `before` frames back and `after` ahead holds them."""
    timed = cells.join(frames, "video_id")
    return timed.withColumn("at", F.explode(F.sequence(F.greatest(F.col("t") - after, "first"), F.least(F.col("t") + before, "last"))))


def sparse_persistence(cells: DataFrame, frames: DataFrame, width: int = 15) -> DataFrame:
    """p15 of a sparse grid, whose missing rows are zero vectors: a row for each cell and frame that some vector reaches, and no others;
    elsewhere it is 0. `frames` is of `series`."""
    keys = _cell(cells)
    found = reached(cells, frames, (width - 1) // 2, width // 2)
    sums = found.groupBy(*keys, F.col("at").alias("t")).agg(F.sum(F.col("u").cast("double")).alias("u"), F.sum(F.col("v").cast("double")).alias("v"), F.sum(_length(F.col("u"), F.col("v"))).alias("total"))
    return sums.select(*keys, "t", _share(F.col("u"), F.col("v"), F.col("total")).alias("p15"))


def sparse_gate(cells: DataFrame, width: int = 15, least: float = 0.85) -> DataFrame:
    """`gate` for the rows that there are, by windows over their frames: missing rows add nothing to its sums."""
    over = Window.partitionBy(*_cell(cells)).orderBy("t").rangeBetween(-((width - 1) // 2), width // 2)
    p15 = _share(*(F.sum(c).over(over) for c in (F.col("u").cast("double"), F.col("v").cast("double"), _length(F.col("u"), F.col("v")))))
    out = cells.withColumn("p15", p15)
    keep = F.col("p15").cast("double") >= least
    return out.withColumns({"keep": keep, "u": F.when(keep, F.col("u")).otherwise(F.lit(0.0)), "v": F.when(keep, F.col("v")).otherwise(F.lit(0.0))})


def sparse_moving_mean(cells: DataFrame, frames: DataFrame, radius: int = 2) -> DataFrame:
    """`moving_mean` of a sparse grid: a row for each cell and frame that some vector reaches. The mean is over the frames of the series
    within the radius, which its first and last frame tell; no frame is made up to be counted."""
    keys = _cell(cells)
    some = reached(cells.where("u <> 0 or v <> 0"), frames, radius, radius)
    sums = some.groupBy(*keys, F.col("at").alias("t"), "first", "last").agg(F.sum(F.col("u").cast("double")).alias("u"), F.sum(F.col("v").cast("double")).alias("v"))
    n = F.least(F.col("t") + radius, "last") - F.greatest(F.col("t") - radius, "first") + 1
    return sums.select(*keys, "t", *((F.col(c) / n).cast("float").alias(c) for c in ("u", "v")))


def sparse_gated_mean(cells: DataFrame, frames: DataFrame, width: int = 15, least: float = 0.85, radius: int = 2) -> DataFrame:
    """`gated_mean` of a sparse grid, without a row for each cell and frame: the rows that are not zero."""
    out = sparse_moving_mean(sparse_gate(cells, width, least), frames, max(0, radius))
    return out.withColumn("m", magnitude(F.col("u").cast("double"), F.col("v").cast("double")).cast("float"))


def gate_counts(df: DataFrame) -> DataFrame:
    """Kept and rejected vectors; to be taken before the series is aligned."""
    keys = [c for c in ("video_id", "gap") if c in df.columns]
    return df.groupBy(*keys).agg(F.count_if("keep").alias("n_keep"), F.count_if(~F.col("keep")).alias("n_reject"))


def align(df: DataFrame, start: int) -> DataFrame:
    """Drops frames before `start` and counts t from there. A filter on t stays above the windows."""
    return df.where(F.col("t") >= start).withColumn("t", F.col("t") - start)
