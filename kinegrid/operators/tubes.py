"""Tubes: block events merged over neighbouring cells and near times.

A tube table holds members: video_id, tube_id, event_id, y, x, t0, t1. Neighbour and proximity joins explode the cells
around each cell and join on equality, never on a distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import discard, materialise
from .graph import connected_components


def chebyshev_offsets(radius: int, own: bool = False):
    """Offsets within the radius as an array of structs, the cell itself only if `own`."""
    if radius < 1:
        raise ValueError("radius must be 1 or more")
    r = range(-radius, radius + 1)
    return F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in r for dx in r if own or dy or dx))


def _stretches(first: str, last: str, length: int):
    """The numbers of the stretches of `length` that an inclusive interval reaches."""
    return F.explode(F.sequence(F.floor(F.col(first) / length), F.floor(F.col(last) / length)))


def neighbour_edges(events: DataFrame, radius: int = 2, stretch: int = 64) -> DataFrame:
    """video_id, a, b (a < b): events of different cells within the radius that overlap in time.

    Events meet by cell and stretch of time; a pair counts in the stretch in which its overlap begins."""
    timed = events.select("video_id", "event_id", "y", "x", "t0", "t1", _stretches("t0", "t1", stretch).alias("s"))
    near = timed.select("video_id", F.col("event_id").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), "y", "x", "s", F.explode(chebyshev_offsets(radius)).alias("o"))
    near = near.select("video_id", "s", "a", "a0", "a1", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    other = timed.select("video_id", "s", "y", "x", F.col("event_id").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    begins = F.floor(F.greatest("a0", "b0") / stretch) == F.col("s")
    return near.join(other, ["video_id", "s", "y", "x"]).where(F.expr("a < b and a0 <= b1 and b0 <= a1") & begins).select("video_id", "a", "b")


def components(edges: DataFrame) -> DataFrame:
    """video_id, node, component over edges (video_id, a, b)."""
    found = connected_components(edges.select(F.struct("video_id", F.col("a").alias("id")).alias("a"), F.struct("video_id", F.col("b").alias("id")).alias("b")), materialise, drop=discard)
    return found.select("node.video_id", F.col("node.id").alias("node"), F.col("component.id").alias("component"))


def tube_stats(members: DataFrame) -> DataFrame:
    """t0, t1, duration, num_cells, num_block_events and the half-open box of each tube."""
    stats = members.groupBy("video_id", "tube_id").agg(
        F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.count_distinct(F.struct("y", "x")).cast("int").alias("num_cells"), F.count("*").cast("int").alias("num_block_events"),
        F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"),
    )
    return stats.withColumn("duration", F.col("t1") - F.col("t0") + 1)


def renumber(members: DataFrame, stats: DataFrame) -> DataFrame:
    """Tube ids by (t0, more cells first, previous id), from 1 within each video."""
    order = Window.partitionBy("video_id").orderBy("t0", F.desc("num_cells"), "tube_id")
    ids = stats.select("video_id", "tube_id", F.row_number().over(order).alias("new"))
    return members.join(ids, ["video_id", "tube_id"]).withColumn("tube_id", F.col("new")).drop("new")


def _large(stats: DataFrame, cells: int, duration: int) -> DataFrame:
    return stats.where((F.col("num_cells") >= cells) & (F.col("duration") >= duration))


def merge_events(events: DataFrame, radius: int = 2, min_cells: int = 2, min_duration: int = 3) -> DataFrame:
    """Members of the components of neighbouring events that are large and long enough."""
    labels = components(materialise(neighbour_edges(events, radius), "edges")).withColumnRenamed("node", "event_id")
    members = events.select("video_id", "event_id", "y", "x", "t0", "t1").join(labels, ["video_id", "event_id"], "left").withColumn("tube_id", F.coalesce("component", "event_id")).drop("component")
    members = materialise(members, "members")
    kept = _large(tube_stats(members), min_cells, min_duration)
    return renumber(members.join(kept.select("video_id", "tube_id"), ["video_id", "tube_id"]), kept)


def hull_cells(members: DataFrame, gap: int, stretch: int) -> DataFrame:
    """video_id, tube_id, y, x, s, t0, t1: each tube's cells, with its whole time, once for each stretch that its time reaches when it is
    `gap` + 1 frames longer. Two tubes are `gap` frames apart or nearer if times so widened overlap."""
    hull = members.groupBy("video_id", "tube_id").agg(F.min("t0").alias("t0"), (F.max("t1") + gap + 1).alias("t1"))
    return members.select("video_id", "tube_id", "y", "x").distinct().join(hull, ["video_id", "tube_id"]).select("*", _stretches("t0", "t1", stretch).alias("s"))


def meetings(members: DataFrame, distance: int = 2, gap: int = 20, grown: DataFrame | None = None, stretch: int = 128) -> DataFrame:
    """video_id, a, b and both widened times of the tubes that have cells within the distance and meet in a stretch of time: what
    `proximity_edges` tests. With `grown` (video_id, tube_id), `a` is one of these, and pairs may come both ways."""
    cells = hull_cells(members, gap, stretch)
    asked = cells if grown is None else cells.join(grown, ["video_id", "tube_id"], "left_semi")
    near = asked.select("video_id", "s", F.col("tube_id").alias("a"), F.col("t0").alias("a0"), F.col("t1").alias("a1"), "y", "x", F.explode(chebyshev_offsets(distance, own=True)).alias("o"))
    near = near.select("video_id", "s", "a", "a0", "a1", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    other = cells.select("video_id", "s", "y", "x", F.col("tube_id").alias("b"), F.col("t0").alias("b0"), F.col("t1").alias("b1"))
    return near.join(other, ["video_id", "s", "y", "x"]).where("a < b" if grown is None else "a <> b")


def proximity_edges(members: DataFrame, distance: int = 2, gap: int = 20, grown: DataFrame | None = None, stretch: int = 128) -> DataFrame:
    """video_id, a, b (a < b): tubes with cells within the distance, at whatever times, and at most `gap` frames apart; with `grown`
    only pairs with one of these.

    Tubes meet by cell and stretch of time, so that those of other times do not meet at all."""
    met = meetings(members, distance, gap, grown, stretch).where("a0 <= b1 and b0 <= a1")
    return met.select("video_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def proximity_merge(members: DataFrame, distance: int = 2, gap: int = 20) -> DataFrame:
    """Merges near tubes until none are near. A merged tube has the least id of its parts.

    Tubes that were not near before are near only if one of them has grown: after the first round only the tubes that the last
    one merged look for others. Each round's tubes are stored, which cuts the plan, and replace those of the round before."""
    members, grown = materialise(members, "tubes"), None
    while True:
        edges = materialise(proximity_edges(members, distance, gap, grown), "near")
        if edges.isEmpty():
            discard(edges)
            return renumber(members, tube_stats(members))
        labels = materialise(components(edges).withColumnRenamed("node", "tube_id"), "labels")
        grown = labels.select("video_id", F.col("component").alias("tube_id")).distinct()
        before = members
        members = materialise(members.join(labels, ["video_id", "tube_id"], "left").withColumn("tube_id", F.coalesce("component", "tube_id")).drop("component"), "tubes")
        discard(before, edges)


def contained(stats: DataFrame, stretch: int = 64, block: int = 8) -> DataFrame:
    """video_id, tube_id of tubes whose box in x, y and t lies in another's that is not the same.

    A box lies only in boxes that hold its least corner: each box meets those that reach the corner's block of space and time."""
    boxes = stats.select("video_id", "tube_id", "t0", "t1", "x1", "y1", "x2", "y2")
    keys = {"bt": ("t0", "t1", stretch), "by": ("y1", "y2", block), "bx": ("x1", "x2", block)}
    inner = boxes.select("*", *(F.floor(F.col(first) / size).alias(k) for k, (first, _, size) in keys.items()))
    outer = boxes.select("video_id", *(F.col(c).alias(f"o_{c}") for c in boxes.columns[1:]))
    for k, (first, last, size) in keys.items():
        outer = outer.select("*", _stretches(f"o_{first}", f"o_{last}", size).alias(f"o_{k}"))
    outer = outer.withColumnRenamed("video_id", "o_video_id")
    inside = "o_t0 <= t0 and o_t1 >= t1 and o_x1 <= x1 and o_y1 <= y1 and o_x2 >= x2 and o_y2 >= y2"
    same = "o_t0 = t0 and o_t1 = t1 and o_x1 = x1 and o_y1 = y1 and o_x2 = x2 and o_y2 = y2"
    meet = "video_id = o_video_id and bt = o_bt and by = o_by and bx = o_bx"
    found = inner.join(outer, F.expr(f"{meet} and o_tube_id <> tube_id and {inside} and not ({same})"), "left_semi")
    return found.select("video_id", "tube_id")


def suppress_contained(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members of the tubes that stay, renumbered; the removed ids, as they were numbered before)."""
    stats = materialise(tube_stats(members), "stats")
    removed = contained(stats)
    kept = stats.join(removed, ["video_id", "tube_id"], "left_anti")
    return renumber(members.join(kept.select("video_id", "tube_id"), ["video_id", "tube_id"]), kept), removed


def build_tubes(cells: DataFrame, params, value: str = "mu") -> DataFrame:
    """Members of the final tubes of a unit map."""
    from .events import block_events

    events = materialise(block_events(cells, params.tau_high, params.tau_low, params.max_gap, params.min_event, value), "events")
    members = merge_events(events, params.neighbour_radius, params.min_tube_cells, params.min_tube_duration)
    members = proximity_merge(members, params.merge_distance, params.merge_gap)
    kept = _large(tube_stats(members), params.min_tube_cells, params.min_tube_duration)
    members = materialise(renumber(members.join(kept.select("video_id", "tube_id"), ["video_id", "tube_id"]), kept), "tubes")
    return suppress_contained(members)[0] if params.suppress_contained else members


def overlays(members: DataFrame) -> DataFrame:
    """video_id, t, tube_id, the tube's box and the cells active at t, for every frame of each tube's life."""
    stats = tube_stats(members)
    frames = stats.select("video_id", "tube_id", "x1", "y1", "x2", "y2", F.explode(F.sequence("t0", "t1")).alias("t"))
    active = members.select("video_id", "tube_id", "y", "x", F.explode(F.sequence("t0", "t1")).alias("t")).groupBy("video_id", "tube_id", "t").agg(F.array_sort(F.collect_set(F.struct("y", "x"))).alias("cells"))
    return frames.join(active, ["video_id", "tube_id", "t"], "left").select("video_id", "t", "tube_id", F.array("x1", "y1", "x2", "y2").alias("bbox"), F.transform(F.coalesce("cells", F.array().cast("array<struct<y:int,x:int>>")), lambda c: F.array(c["y"], c["x"])).alias("cells"))


def active_boxes(members: DataFrame) -> DataFrame:
    """Half-open box of the cells active at each frame; frames without one have no row."""
    active = members.select("video_id", "tube_id", "y", "x", F.explode(F.sequence("t0", "t1")).alias("t"))
    return active.groupBy("video_id", "tube_id", "t").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), (F.max("x") + 1).alias("x2"), (F.max("y") + 1).alias("y2"))


def tracks(members: DataFrame) -> DataFrame:
    """The nested table of tubes: a row with members and frames for each."""
    stats = tube_stats(members)
    parts = members.groupBy("video_id", "tube_id").agg(F.array_sort(F.collect_list(F.struct("t0", "y", "x", "event_id", "t1"))).alias("m"))
    parts = parts.select("video_id", "tube_id", F.transform("m", lambda m: F.struct(m["event_id"].alias("event_id"), m["y"].alias("y"), m["x"].alias("x"), m["t0"].alias("t0"), m["t1"].alias("t1"), (m["t1"] - m["t0"] + 1).alias("duration"))).alias("members"))
    frames = overlays(members).groupBy("video_id", "tube_id").agg(F.array_sort(F.collect_list(F.struct(F.col("t").alias("frame_index"), F.col("bbox").alias("bbox_grid"), "cells"))).alias("per_frame"))
    return stats.join(parts, ["video_id", "tube_id"]).join(frames, ["video_id", "tube_id"]).select("video_id", "tube_id", "t0", "t1", "duration", "num_cells", "num_block_events", F.array("x1", "y1", "x2", "y2").alias("spatial_bbox_grid"), "members", "per_frame")


def hull_prisms(members: DataFrame, unit: int = 1) -> DataFrame:
    """Corner points (x, t, y) of each whole tube's box, with the end of time exclusive."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dt"), F.lit(k).alias("dy")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))).alias("c")
    rows = tube_stats(members).select("*", corner)
    pick = lambda flag, low, high: F.when(F.col(f"c.{flag}") == 0, low).otherwise(high)
    return rows.select("video_id", "tube_id", (pick("dx", F.col("x1"), F.col("x2")) * unit).alias("px"), pick("dt", F.col("t0"), F.col("t1") + 1).alias("pt"), (pick("dy", F.col("y1"), F.col("y2")) * unit).alias("py"))


def prisms(members: DataFrame, unit: int = 1) -> DataFrame:
    """Corner points (x, t, y) of a box for each event, with the end of time exclusive."""
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("dx"), F.lit(j).alias("dt"), F.lit(k).alias("dy")) for i in (0, 1) for j in (0, 1) for k in (0, 1)))).alias("c")
    rows = members.select("video_id", "tube_id", "event_id", "y", "x", "t0", "t1", corner)
    return rows.select("video_id", "tube_id", "event_id", ((F.col("x") + F.col("c.dx")) * unit).alias("px"), F.when(F.col("c.dt") == 0, F.col("t0")).otherwise(F.col("t1") + 1).alias("pt"), ((F.col("y") + F.col("c.dy")) * unit).alias("py"))
