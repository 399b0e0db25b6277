"""Structure tensor and aperture reliability as projections over pixel rows (the dense kernels do the same on arrays)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import FRAME, convolved

# The 3x3 Sobel weights, (x, y) for each (dy, dx); `gradients` takes them apart by axis.
SOBEL = {(-1, -1): (-1, -1), (-1, 0): (0, -2), (-1, 1): (1, -1), (0, -1): (-2, 0), (0, 1): (2, 0), (1, -1): (-1, 1), (1, 0): (0, 2), (1, 1): (1, 1)}


def gradients(pixels: DataFrame, height: int, width: int) -> DataFrame:
    """ix, iy of each pixel's value g: differences along one axis of what is smoothed along the other."""
    smooth, change = {-1: 1, 0: 2, 1: 1}, {-1: -1, 1: 1}
    frame = [c for c in FRAME if c in pixels.columns]
    rows = convolved(pixels.repartition(*frame), "x", width, {"ix": ("g", change), "iy": ("g", smooth)})
    return convolved(rows, "y", height, {"ix": ("ix", smooth), "iy": ("iy", change)})


def gaussian_weights(sigma: float) -> list[float]:
    """Normalised weights of an odd kernel of about 8 sigma."""
    size = round(8 * sigma + 1) | 1
    w = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [x / sum(w) for x in w]


def tensor(grads: DataFrame) -> DataFrame:
    """The products that a structure tensor averages."""
    return grads.withColumns({"jxx": F.col("ix") * F.col("ix"), "jyy": F.col("iy") * F.col("iy"), "jxy": F.col("ix") * F.col("iy")})


def smoothed(products: DataFrame, height: int, width: int, sigma: float = 1.5) -> DataFrame:
    """The products, averaged by a Gaussian: along the rows, then along the columns."""
    names = ("jxx", "jyy", "jxy")
    weights = gaussian_weights(sigma)
    by_offset = {i - len(weights) // 2: w for i, w in enumerate(weights)}
    taps = {n: (n, by_offset) for n in names}
    return convolved(convolved(products, "x", width, taps), "y", height, taps)


def eigenvalues(df: DataFrame) -> DataFrame:
    """lambda1 >= lambda2 >= 0 of jxx, jyy, jxy."""
    trace = F.col("jxx") + F.col("jyy")
    root = F.sqrt(F.greatest(F.pow(F.col("jxx") - F.col("jyy"), F.lit(2)) + 4 * F.col("jxy") * F.col("jxy"), F.lit(0.0)))
    return df.withColumns({"lambda1": F.greatest(F.lit(0.0), (trace + root) / 2), "lambda2": F.greatest(F.lit(0.0), (trace - root) / 2)})


def tangent(df: DataFrame) -> DataFrame:
    """tx, ty: the unit vector along the edge; (1, 0) where neither form of the normal has a length."""
    first, second = (F.col("jxy"), F.col("lambda1") - F.col("jxx")), (F.col("lambda1") - F.col("jyy"), F.col("jxy"))
    length = [F.hypot(*n) for n in (first, second)]
    pick = lambda i: F.when(length[0] >= 1e-6, first[i] / length[0]).when(length[1] >= 1e-6, second[i] / length[1])
    return df.withColumns({"tx": F.coalesce(-pick(1), F.lit(1.0)), "ty": F.coalesce(pick(0), F.lit(0.0))})


def aperture_reliability(df: DataFrame, strong: float = 950.0, power: float = 2.0, alpha: float = 1.0, eps: float = 1e-6) -> DataFrame:
    """r: 1, less by how far a strong straight edge runs along the motion (u, v)."""
    length = F.hypot("u", "v")
    edgeness = 1 - F.col("lambda2") / (F.col("lambda1") + eps)
    along = F.abs(F.col("u") * F.col("tx") + F.col("v") * F.col("ty")) / F.greatest(length, F.lit(1e-6))
    along = F.when(length < 1e-6, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), along)))
    penalty = F.when(F.col("lambda1") > strong, edgeness * F.pow(along, F.lit(power))).otherwise(0.0)
    return df.withColumn("r", F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - alpha * penalty)))


def tensor_reliability(df: DataFrame, scale: float = 400.0, eps: float = 1e-6) -> DataFrame:
    """shape, strength and their product r_st, the older reliability."""
    shape = F.col("lambda2") / (F.col("lambda1") + eps)
    strength = 1 - F.exp(-F.col("lambda2") / scale)
    return df.withColumns({"shape": shape, "strength": strength}).withColumn("r_st", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("shape") * F.col("strength"))))


def rescaled(u: Column, v: Column, width: float, height: float, full_width: float, full_height: float) -> tuple[Column, Column]:
    """Vector in pixels of the full size."""
    return u * (full_width / width), v * (full_height / height)
