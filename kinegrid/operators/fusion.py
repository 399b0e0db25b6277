"""Fusion of the gaps' maps. Gaps are rows, so each gap's map is one more row of a group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import nan_to_null

KEYS = ("video_id", "t", "y", "x")


def normalise(cells: DataFrame, divisors: dict[int, float]) -> DataFrame:
    """u, v, m over the gap's divisor, 1 for a gap that has none, rounded to single precision. The divisors are a small
    broadcast table."""
    if any(d <= 0 for d in divisors.values()):
        raise ValueError("gap divisors must be positive")
    table = cells.sparkSession.createDataFrame([*divisors.items()], "gap int, div double")
    joined = cells.join(F.broadcast(table), "gap", "left").withColumn("div", F.coalesce("div", F.lit(1.0)))
    return joined.withColumns({c: (F.col(c) / F.col("div")).cast("float") for c in ("u", "v", "m") if c in cells.columns}).drop("div")


def complete(cells: DataFrame, gaps: int) -> DataFrame:
    """The (video, t, y, x) that every gap has, with the number of gaps found."""
    return cells.groupBy(*KEYS).agg(F.count("*").alias("n_gaps")).where(F.col("n_gaps") == gaps)


def fuse_magnitudes(cells: DataFrame, fusion: str) -> DataFrame:
    """Over the gaps, in double precision; the result is rounded to single."""
    m = nan_to_null(F.col("m").cast("double"))
    how = {"mean": F.avg(m), "max": F.max(m), "median": F.percentile(m, 0.5), "rms": F.sqrt(F.avg(m * m))}
    if fusion not in how:
        raise ValueError(f"unknown fusion {fusion}")
    return cells.groupBy(*KEYS).agg(F.coalesce(how[fusion], F.lit(float("nan"))).cast("float").alias("m"))


def fuse_vectors(cells: DataFrame, fusion: str) -> DataFrame:
    """max takes the whole vector of the longest, the smallest gap among equals; the others go by component, in double
    precision, and are rounded to single. The sum of a few single-precision values is exact, and so is the sign of their mean; 0 counts as +1."""
    if fusion == "max":
        u, v = F.col("u").cast("double"), F.col("v").cast("double")
        length = F.sqrt(u * u + v * v)
        best = F.max_by(F.struct("u", "v"), F.when(~F.isnan(length), F.struct(length.alias("l"), (-F.col("gap")).alias("g"))))
        return cells.groupBy(*KEYS).agg(best.alias("b")).select(*KEYS, F.col("b.u").cast("float").alias("u"), F.col("b.v").cast("float").alias("v"))

    def one(c: str):
        value = nan_to_null(F.col(c).cast("double"))
        rms = F.sqrt(F.avg(value * value)) * F.when(F.avg(value) < 0, -1.0).otherwise(1.0)
        return {"mean": F.avg(value), "median": F.percentile(value, 0.5), "rms": rms}[fusion]

    return cells.groupBy(*KEYS).agg(*(one(c).cast("float").alias(c) for c in ("u", "v")))
