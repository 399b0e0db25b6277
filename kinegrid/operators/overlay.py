"""Geometry and shading of overlays, as rows; drawing itself is left to the consumer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import colour, heat_level


def pixel_boxes(boxes: DataFrame, cell: int, width: int, height: int) -> DataFrame:
    """Boxes of the grid in pixels, their ends cut to the frame, with the tube's colour."""
    return boxes.withColumns({"px1": F.least(F.col("x1") * cell, F.lit(width)), "py1": F.least(F.col("y1") * cell, F.lit(height)), "px2": F.least(F.col("x2") * cell, F.lit(width)), "py2": F.least(F.col("y2") * cell, F.lit(height)), "colour": colour(F.col("tube_id"))})


def expanded(cells: DataFrame, cell: int, height: int, width: int) -> DataFrame:
    """Each cell's pixels, cut to the frame."""
    out = cells.select("*", F.explode(F.sequence(F.lit(0), F.lit(cell - 1))).alias("dy")).select("*", F.explode(F.sequence(F.lit(0), F.lit(cell - 1))).alias("dx"))
    out = out.withColumns({"py": F.col("y") * cell + F.col("dy"), "px": F.col("x") * cell + F.col("dx")}).drop("dy", "dx")
    return out.where((F.col("py") < height) & (F.col("px") < width))


# The published polynomial approximation of the colour map "turbo", by powers of the level.
TURBO = {
    "red": (0.13572138, 4.61539260, -42.66032258, 132.13108234, -152.94239396, 59.28637943),
    "green": (0.09140261, 2.19418839, 4.84296658, -14.18503333, 4.27729857, 2.82956604),
    "blue": (0.10667330, 12.64194608, -60.58204836, 110.36276771, -89.90310912, 27.34824973),
}


def heat_colours(cells: DataFrame, level: str = "level") -> DataFrame:
    """Adds red, green and blue (0..255) of a level in 0..1, in 256 steps."""
    x = F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(level))) * 255) / 255

    def shade(weights: tuple[float, ...]) -> Column:
        out = F.lit(weights[-1])
        for w in reversed(weights[:-1]):
            out = out * x + w
        return F.rint(F.greatest(F.lit(0.0), F.least(F.lit(1.0), out)) * 255).cast("int")

    return cells.withColumns({k: shade(w) for k, w in TURBO.items()})


def blended(pixels: DataFrame, value: str, low: float, high: float, max_alpha: float = 0.75) -> DataFrame:
    """Blends background `g` and heat colour `heat` (0..255) by the heat level, truncated to whole shades."""
    alpha = heat_level(F.col(value), low, high) * max_alpha
    return pixels.withColumn("shade", F.floor(F.col("g") * (1 - alpha) + F.col("heat") * alpha).cast("int"))


def letterboxed(sizes: DataFrame, width: int, height: int) -> DataFrame:
    """Size and place of an image of (w, h) that is fitted into a canvas with its aspect kept."""
    scale = F.least(F.lit(width) / F.col("w"), F.lit(height) / F.col("h"))
    out = sizes.withColumns({"fit_w": F.greatest(F.lit(1), F.rint(F.col("w") * scale).cast("int")), "fit_h": F.greatest(F.lit(1), F.rint(F.col("h") * scale).cast("int"))})
    return out.withColumns({"left": F.floor((F.lit(width) - F.col("fit_w")) / 2).cast("int"), "top": F.floor((F.lit(height) - F.col("fit_h")) / 2).cast("int")})
