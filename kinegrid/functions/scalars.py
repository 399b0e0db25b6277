"""Column functions of the pixel and cell projections."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def nan_to_null(value: Column) -> Column:
    return F.when(F.isnan(value), F.lit(None)).otherwise(value)


def magnitude(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def suppressed(u: Column, v: Column, least: float) -> tuple[Column, Column]:
    """Both components are zero where the vector is shorter than `least`; a `least` of 0 or less changes nothing."""
    if least <= 0:
        return u, v
    short = F.hypot(u, v) < least
    return F.when(short, 0.0).otherwise(u), F.when(short, 0.0).otherwise(v)


def sampling_step(native_fps: Column, target_fps: Column) -> Column:
    """Frames per sample, rounded half to even, 1 at least."""
    return F.greatest(F.lit(1), F.bround(native_fps / target_fps).cast("int"))


def scaled_size(pixels: Column, scale: float) -> Column:
    return F.greatest(F.lit(1), F.floor(pixels * scale).cast("int"))


def cells_along(pixels: Column, stride: int) -> Column:
    return F.ceil(pixels / stride).cast("int")


def centre(index: Column, stride: int, pixels: Column) -> Column:
    """The pixel at the centre of a cell."""
    return F.least(index * stride + stride // 2, pixels - 1)


def reflected(index: Column, size: int) -> Column:
    """The index mirrored at the borders, which are not repeated; for less than one size outside."""
    return F.when(index < 0, -index).when(index >= size, 2 * (size - 1) - index).otherwise(index)


def heat_level(value: Column, low: float, high: float) -> Column:
    """0 below `low` or where it is not finite, else the value over `high`, 1 at most."""
    return F.when(finite(value) & (value >= low), F.greatest(F.lit(0.0), F.least(F.lit(1.0), value / high))).otherwise(0.0)


def time_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Frames strictly between two intervals, 0 if they overlap or touch."""
    return F.greatest(F.lit(0), b0 - a1 - 1, a0 - b1 - 1)


def colour(tube_id: Column, colours: int = 10) -> Column:
    return F.pmod(tube_id - 1, F.lit(colours))


def gray(red: Column, green: Column, blue: Column) -> Column:
    """Luma as whole shades."""
    return F.rint(0.299 * red + 0.587 * green + 0.114 * blue)
