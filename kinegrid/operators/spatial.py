"""Aggregates over neighbouring pixels or cells."""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import centre, nan_to_null, reflected, suppressed

FRAME = ("video_id", "gap", "t")


def _frame(df: DataFrame) -> list[str]:
    return [c for c in FRAME if c in df.columns]


def block_mean(df: DataFrame, block: int, least: float | None = None, values: tuple[str, ...] = ("u", "v")) -> DataFrame:
    """Means over blocks that do not overlap; those at the edge may be partial. With `least`, short vectors are zero first."""
    if least is not None:
        u, v = suppressed(F.col("u"), F.col("v"), least)
        df = df.withColumns({"u": u, "v": v})
    return df.groupBy(*_frame(df), F.floor(F.col("y") / block).cast("int").alias("y"), F.floor(F.col("x") / block).cast("int").alias("x")).agg(*(F.avg(c).alias(c) for c in values))


def block_max(df: DataFrame, block: int, value: str = "m") -> DataFrame:
    """Largest value that is a number in each block, in single precision; NaN if there is none."""
    best = F.coalesce(F.max(nan_to_null(F.col(value))), F.lit(float("nan"))).cast("float")
    return df.groupBy(*_frame(df), F.floor(F.col("y") / block).cast("int").alias("y"), F.floor(F.col("x") / block).cast("int").alias("x")).agg(best.alias(value))


def downscale(df: DataFrame, factor: int, value: str = "g") -> DataFrame:
    """Area mean for sizes that the factor divides."""
    return block_mean(df, factor, values=(value,))


def area_mean(df: DataFrame, height: int, width: int, scale: float, value: str = "g") -> DataFrame:
    """Area mean at another, smaller size, whatever it is: each pixel counts in the two by two cells that it may lie in, by the share
    that lies there. Shares are whole numbers, in units of a pixel's side over the new size."""
    if not 0 < scale <= 1:
        raise ValueError("the scale must be above 0 and at most 1")
    out = df
    for axis, n in (("y", height), ("x", width)):
        size = max(1, int(n * scale))
        low, high = F.col(axis) * size, (F.col(axis) + 1) * size
        out = out.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(low / n), F.floor((high - 1) / n))))
        out = out.withColumn(f"s{axis}", F.least(high, (F.col(f"c{axis}") + 1) * n) - F.greatest(low, F.col(f"c{axis}") * n))
    share = (F.col("sy") * F.col("sx")).cast("double")
    return out.groupBy(*_frame(df), F.col("cy").cast("int").alias("y"), F.col("cx").cast("int").alias("x")).agg((F.sum(F.col(value) * share) / F.sum(share)).alias(value))


def _along(axis: str) -> str:
    return {"x": "y", "y": "x"}[axis]


def lines(df: DataFrame, axis: str, length: int, names: list[str]) -> DataFrame:
    """A row for each line of a frame along `axis`: `at`, the positions that it has, and `line`, its values at 0..length - 1 (structs of
    `names`, null where there is none)."""
    found = df.groupBy(*_frame(df), _along(axis)).agg(F.array_sort(F.collect_list(F.struct(F.col(axis).cast("int").alias("at"), F.struct(*names).alias("value")))).alias("cells"))
    whole = F.transform("cells", lambda c: c["value"])
    known = F.map_from_entries("cells")
    sparse = F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.try_element_at(known, i))
    return found.select(*_frame(df), _along(axis), F.transform("cells", lambda c: c["at"]).alias("at"), F.when(F.size("cells") == length, whole).otherwise(sparse).alias("line"))


def _flat(df: DataFrame, axis: str, cells: Column) -> DataFrame:
    """The lines' cells (structs that start with their position along the axis) as rows again."""
    out = df.select(*_frame(df), _along(axis), F.inline(cells))
    return out.select(*_frame(df), "y", "x", *(c for c in out.columns if c not in (*_frame(df), "y", "x")))


def convolved(df: DataFrame, axis: str, length: int, taps: dict[str, tuple[str, dict[int, float]]]) -> DataFrame:
    """Weighted sums along `axis`, mirrored at the ends: `taps` maps a new column to a value and its weights by offset.

    Each line is one array, which its own cells index: neighbours are neither exploded nor joined. Cells that a line lacks
    count nothing and have no row."""
    names = list(dict.fromkeys(v for v, _ in taps.values()))
    found = lines(df, axis, length, names)

    def at(i: Column, value: str, weights: dict[int, float]) -> Column:
        part = lambda d, w: F.coalesce(F.get("line", reflected(i + d, length))[value], F.lit(0.0)) * F.lit(float(w))
        return functools.reduce(operator.add, (part(d, w) for d, w in weights.items() if w))

    cells = F.transform("at", lambda i: F.struct(i.alias(axis), *(at(i, v, w).alias(n) for n, (v, w) in taps.items())))
    return _flat(found, axis, cells)


def box_sums(df: DataFrame, axis: str, length: int, stride: int, window: int, names: list[str]) -> DataFrame:
    """Sums over the window around the centre of each cell of `stride` along `axis`, mirrored at the ends: the axis becomes cells.

    Prefix sums of a line give the sum of any stretch by two look-ups, of what is mirrored by two more at either end."""
    over = Window.partitionBy(*_frame(df), _along(axis)).orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    sums = df.withColumns({n: F.sum(F.col(n).cast("double")).over(over) for n in names})
    found = lines(sums, axis, length, names)
    # a cell that a line lacks has the prefix sum of the one before it
    carried = F.aggregate("line", F.struct(F.array().cast(f"array<struct<{','.join(f'{n}:double' for n in names)}>>").alias("done"), F.struct(*(F.lit(0.0).alias(n) for n in names)).alias("last")), lambda a, x: F.struct(F.array_append(a["done"], F.coalesce(x, a["last"])).alias("done"), F.coalesce(x, a["last"]).alias("last")), lambda a: a["done"])
    found = found.withColumn("line", F.when(F.size("at") == length, F.col("line")).otherwise(carried))

    def stretch(low: Column, high: Column, name: str) -> Column:
        upto = lambda i: F.when(i < 0, F.lit(0.0)).otherwise(F.get("line", F.greatest(i, F.lit(0)))[name])
        return F.when(high < low, F.lit(0.0)).otherwise(upto(high) - upto(low - 1))

    def box(i: Column, name: str) -> Column:
        mid, last = centre(i, stride, F.lit(length)), length - 1
        low, high = mid - window // 2, mid + window - window // 2 - 1
        return stretch(F.greatest(low, F.lit(0)), F.least(high, F.lit(last)), name) + stretch(F.lit(1), -low, name) + stretch(2 * last - high, F.lit(last - 1), name)

    cells = F.transform(F.sequence(F.lit(0), F.lit(-(-length // stride) - 1)), lambda i: F.struct(i.cast("int").alias(axis), *(box(i, n).alias(n) for n in names)))
    return _flat(found, axis, cells)


def weighted_sums(pixels: DataFrame, height: int, width: int, stride: int = 4, window: int = 8) -> DataFrame:
    """wu, wv, w: sums in the window around each cell's centre. They may be added over frames before their ratio is taken."""
    products = pixels.repartition(*_frame(pixels)).select(*_frame(pixels), "y", "x", (F.col("w") * F.col("u")).alias("wu"), (F.col("w") * F.col("v")).alias("wv"), F.col("w").cast("double").alias("w"))
    names = ["wu", "wv", "w"]
    return box_sums(box_sums(products, "x", width, stride, window, names), "y", height, stride, window, names)


def window_weighted_mean(pixels: DataFrame, height: int, width: int, stride: int = 4, window: int = 8) -> DataFrame:
    """Weighted mean vector in a window around each cell's centre; windows overlap, borders are mirrored."""
    sums = weighted_sums(pixels, height, width, stride, window)
    # what is left of a difference of prefix sums that cancel is no weight
    return sums.select(*_frame(sums), "y", "x", *(F.when(F.col("w") > 1e-12, F.col(f"w{c}") / F.col("w")).otherwise(0.0).alias(c) for c in ("u", "v")))
