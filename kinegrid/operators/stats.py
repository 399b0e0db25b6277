"""Percentiles, statistics of named boxes, and scaling for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import finite
from ..functions.storage import discard, materialise

PERCENTILES = (50.0, 75.0, 90.0, 95.0, 99.0, 99.9)


#: Values that cut a bracket into parts of about as many values each.
EDGES = 64


def _met(values: DataFrame, brackets: DataFrame, groups: list[str], *more: str) -> DataFrame:
    """The values up to the end of each bracket of their group: those within it, and those below if they have not been counted."""
    packed = brackets.groupBy(*groups).agg(F.collect_list(F.struct("i", "rank", "low", "high", "before", *more)).alias("b"))
    met = values.join(packed, groups) if groups else values.crossJoin(F.broadcast(packed))  # two brackets for each percentile
    return met.select(*groups, "v", F.explode("b").alias("b")).select(*groups, "v", "b.*").where("v <= high and (v >= low or before is null)")


def _narrowed(values: DataFrame, brackets: DataFrame, groups: list[str]) -> DataFrame:
    """For each bracket (i, rank, low, high, before) of a group the part of it that holds the value of that rank. `before` counts the
    values below `low`; where it is null they are counted here.

    A sketch of the bracket cuts it by values that it has: a part is one such value, however often it occurs, or what lies
    between two of them."""
    key = [*groups, "i", "rank"]
    cuts = F.percentile_approx("v", [k / (EDGES - 1) for k in range(EDGES)], 20 * EDGES)
    edges = _met(values, brackets, groups).where("v >= low").groupBy(*key).agg(cuts.alias("edges"))
    cut = brackets.join(edges, key) if groups else brackets.join(F.broadcast(edges), key)
    upto = F.size(F.filter("edges", lambda e: e <= F.col("v")))
    place = F.when(F.col("v") < F.col("low"), -1).otherwise(2 * upto - F.when(F.get("edges", upto - 1) == F.col("v"), 1).otherwise(0))
    bins = _met(values, cut, groups, "edges").groupBy(*key, place.alias("bin")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.coalesce(F.max("before"), F.lit(0)).alias("before"))
    over = Window.partitionBy(*key).orderBy("bin")  # 2 * EDGES + 2 rows at most
    after = F.col("before") + F.sum("n").over(over) - F.col("n")
    return bins.withColumn("before", after).where("before <= rank and rank < before + n").select(*key, "low", "high", "before")


def percentiles_by(df: DataFrame, value: str, groups: list[str], percents: tuple[float, ...] = PERCENTILES, accuracy: int = 10_000) -> DataFrame:
    """The exact interpolated percentiles of the finite values of each group, as columns P50 and so on, with their number n; groups
    without such a value have no row.

    A mergeable sketch brackets both values that a percentile lies between. Sketches of the brackets then narrow these, all at once,
    until each holds one value: nothing is sorted but parts of brackets, so that no task holds a group's values. A round is two
    passes over the stored values; a bracket of n values takes about log(n) / log(EDGES) rounds, whatever their distribution."""
    values = materialise(df.where(finite(F.col(value))).select(*groups, F.col(value).cast("double").alias("v")), "values")
    at = lambda sign: [min(1.0, max(0.0, p / 100 + sign * 2 / accuracy)) for p in percents]
    # the ends of few values are those of all: a sketch of less than `accuracy` values is exact only to its own ranks
    stats = values.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("v", at(-1), accuracy).alias("low"), F.percentile_approx("v", at(1), accuracy).alias("high"), F.min("v").alias("least"), F.max("v").alias("most"))
    stats = materialise(stats, "counts")
    few = F.col("n") < 10 * accuracy
    ask = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(p / 100).alias("p"), F.lit(side).alias("side")) for i, p in enumerate(percents) for side in (0, 1)))).alias("a")
    rank = F.least(F.floor(F.col("a.p") * (F.col("n") - 1)) + F.col("a.side"), F.col("n") - 1)
    pick = lambda ends, edge: F.when(few, F.col(edge)).otherwise(F.get(F.col(ends), F.col("a.i")))
    wide = stats.where("n > 0").select("*", ask).select(*groups, F.col("a.i").alias("i"), rank.cast("long").alias("rank"), pick("low", "least").alias("low"), pick("high", "most").alias("high"), F.lit(None).cast("long").alias("before")).distinct()
    found, spent = materialise(_narrowed(values, wide, groups), "brackets"), None
    while True:
        wide = found.where("low < high")
        if wide.isEmpty():
            break
        spent, found = found, materialise(found.where("low = high").unionByName(_narrowed(values, wide, groups)), "brackets")
        discard(spent)
    known = found.groupBy(*groups, "i").agg(F.min_by("low", "rank").alias("x"), F.max_by("low", "rank").alias("y"))
    named = stats.join(known, groups) if groups else stats.crossJoin(F.broadcast(known))
    at_place = F.element_at(F.array(*(F.lit(p / 100) for p in percents)), F.col("i") + 1) * (F.col("n") - 1)
    value_at = F.col("x") + (F.col("y") - F.col("x")) * (at_place - F.floor(at_place))
    names = [f"P{p:g}".replace(".", "_") for p in percents]
    discard(values)
    return named.groupBy(*groups, "n").agg(*(F.max(F.when(F.col("i") == i, value_at)).alias(x) for i, x in enumerate(names)))


def percentiles(df: DataFrame, value: str, percents: tuple[float, ...] = PERCENTILES, accuracy: int = 10_000) -> DataFrame:
    """One row: `percentiles_by` of all values; NaN if there is none."""
    names = [f"P{p:g}".replace(".", "_") for p in percents]
    found = percentiles_by(df, value, [], percents, accuracy).select(*names)
    return df.sparkSession.range(1).join(found, F.lit(True), "left").select(*(F.coalesce(x, F.lit(float("nan"))).alias(x) for x in names))


def boxed(pixels: DataFrame, rois: DataFrame, height: int, width: int) -> DataFrame:
    """Pixels in each box, cut to the frame. Boxes are a dimension table: each is cut into its rows and columns, joined by
    equality; boxes without pixels stay with nulls."""
    cut = lambda c, most: F.greatest(F.lit(0), F.least(F.col(c), F.lit(most)))
    boxes = rois.select("name", cut("x1", width).alias("x1"), cut("x2", width).alias("x2"), cut("y1", height).alias("y1"), cut("y2", height).alias("y2"))
    span = lambda a, b: F.explode(F.when(F.col(b) > F.col(a), F.sequence(F.col(a), F.col(b) - 1)).otherwise(F.array().cast("array<int>")))
    cells = boxes.select("name", "x1", "x2", span("y1", "y2").alias("y")).select("name", "y", span("x1", "x2").alias("x"))
    return boxes.join(cells.join(pixels, ["y", "x"]), "name", "left")


def box_stats(pixels: DataFrame, rois: DataFrame, height: int, width: int, eps: float = 1e-6) -> DataFrame:
    """n_pixels and means of lambda1, lambda2, shape, strength, r_st, speed and weighted speed in each box, with the share
    of speed that the weighting retains. An empty box has n_pixels 0 and nulls."""
    speed = F.hypot("u", "v")
    found = boxed(pixels, rois, height, width)
    means = {c: F.avg(c) for c in ("lambda1", "lambda2", "shape", "strength", "r_st")} | {"speed": F.avg(speed), "weighted_speed": F.avg(speed * F.col("r_st"))}
    out = found.groupBy("name", "x1", "y1", "x2", "y2").agg(F.count("y").alias("n_pixels"), *(m.alias(f"mean_{k}") for k, m in means.items()))
    return out.withColumn("retention", F.col("mean_weighted_speed") / (F.col("mean_speed") + eps))


def for_display(df: DataFrame, value: str, percent: float = 99.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """Adds `shade`: the value between its least and its percentile (or the given bounds) as 0..255, half to even; values
    that are not finite give 0."""
    v = F.col(value).cast("double")
    top = percentiles(df, value, (percent,)).toDF("hi") if high is None else df.sparkSession.range(1).select(F.lit(high).alias("hi"))
    bounds = df.where(finite(v)).agg(F.min(v).alias("lo")).crossJoin(top)  # one row each
    lo = F.lit(low) if low is not None else F.col("lo")
    hi = F.lit(high) if high is not None else F.col("hi")
    bounds = bounds.select(lo.alias("lo"), F.when(hi <= lo, lo + 1e-6).otherwise(hi).alias("hi"))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    shade = F.when(finite(v), F.rint(share * 255)).otherwise(0.0)
    return df.crossJoin(F.broadcast(bounds)).withColumn("shade", shade.cast("int")).drop("lo", "hi")  # the bounds are one row
