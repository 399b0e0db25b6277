"""Derived views of the driver's tables, for queries and their SQL: the same definition twice, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import temporal

PATCH = 8
#: Embeddings of a clip; users of a clip; frames of a second in the clips of events.
CLIP_PATCHES, CLIP_USERS, FPS = 256, 50, (30.0, 25.0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frame(ts: Column) -> Column:
    return F.floor(F.datediff(ts, F.lit("1995-01-01").cast("date")) / 25).cast("int")


def _order_clip() -> Column:
    """Two clips of lineitem, the first with three quarters of the orders."""
    return F.when(F.col("l_orderkey") % 4 == 0, "clip1").otherwise("clip0")


def v_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, y, x, v: a sparse grid with values in 0..1."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy(_order_clip().alias("video_id"), _frame(F.col("l_shipdate")).alias("t"), (F.col("l_suppkey") % 17).cast("int").alias("y"), (F.col("l_partkey") % 30).cast("int").alias("x")).agg(F.max(F.col("l_discount") * 10 * F.col("l_quantity") / 50).alias("v"))


def v_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, y, x, u, v: a dense vector field, a clip of 4 x 3 cells for each CLIP_USERS users."""
    ev = table(spark, sf_dir, "events")
    t = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 21600).cast("int")
    clip = F.concat(F.lit("clip"), F.floor(F.col("user_id") / CLIP_USERS).cast("string"))
    cells = ev.groupBy(clip.alias("video_id"), t.alias("t"), (F.col("user_id") % 4).cast("int").alias("y"), (F.length("event_type") % 3).cast("int").alias("x")).agg(F.min_by("value", "event_id").alias("u"), ((F.min("event_id") % 7 - 3) * 15).cast("double").alias("v"))
    dense = temporal.densify(cells, cells, ["u", "v"])
    first = cells.groupBy("video_id").agg(F.min("t").alias("first"))
    return dense.join(first, "video_id").select("video_id", (F.col("t") - F.col("first")).alias("t"), "y", "x", "u", "v")


def v_sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, y, x, u, v: vectors in few of the cells of a grid of 100 x 200."""
    li = table(spark, sf_dir, "lineitem")
    cells = li.groupBy(_order_clip().alias("video_id"), _frame(F.col("l_shipdate")).alias("t"), (F.col("l_suppkey") % 100).cast("int").alias("y"), (F.col("l_partkey") % 200).cast("int").alias("x"))
    return cells.agg((F.max("l_quantity") - 10).cast("double").alias("u"), ((F.min("l_tax") * 100 - 4) * 5).cast("double").alias("v"))


def v_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, gap, t, y, x, u, v, m: vectors of five gaps."""
    li = table(spark, sf_dir, "lineitem")
    gap = F.element_at(F.array(*map(F.lit, (1, 5, 10, 20, 50))), (F.col("l_linenumber") % 5 + 1).cast("int"))
    out = li.groupBy(_order_clip().alias("video_id"), gap.alias("gap"), _frame(F.col("l_shipdate")).alias("t"), (F.col("l_suppkey") % 4).cast("int").alias("y"), (F.col("l_partkey") % 4).cast("int").alias("x")).agg((F.min("l_extendedprice") / 10000).alias("u"), (F.max("l_tax") * 100 - 4).alias("v"))
    return out.withColumn("m", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))


def v_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id, t, y, x, g, u, v, w: embeddings as 8 x 8 patches with the motion to the next one; a clip's last has none."""
    emb = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("clip"), F.floor(F.col("vec_id") / CLIP_PATCHES).cast("string")).alias("video_id"), (F.col("vec_id") % CLIP_PATCHES).cast("int").alias("t"), F.transform("embedding", lambda e: e.cast("double")).alias("e"))
    after = emb.select("video_id", (F.col("t") - 1).alias("t"), F.col("e").alias("n"))
    px = emb.join(after, ["video_id", "t"], "left").select("video_id", "t", "e", "n", F.posexplode("e").alias("pos", "value"))
    return px.select("video_id", "t", F.floor(F.col("pos") / PATCH).cast("int").alias("y"), (F.col("pos") % PATCH).cast("int").alias("x"), F.round((F.col("value") + 1) * 127.5).alias("g"), ((F.element_at("n", F.col("pos") + 1) - F.col("value")) * 10).alias("u"), ((F.element_at("n", (F.col("pos") + PATCH) % 64 + 1) - F.col("value")) * 10).alias("v"), (F.abs(F.col("value")) + 0.01).alias("w"))


def v_rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    na = table(spark, sf_dir, "nation").withColumns({"x1": (F.col("n_nationkey") % 6).cast("int"), "y1": (F.col("n_nationkey") % 5).cast("int")})
    return na.select(F.col("n_name").alias("name"), "x1", "y1", (F.col("x1") + 1 + F.col("n_nationkey") % 4).cast("int").alias("x2"), (F.col("y1") + F.col("n_regionkey")).cast("int").alias("y2"))


def v_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All frames of two clips of different rates."""
    clip = F.col("event_id") % len(FPS)
    return table(spark, sf_dir, "events").select(F.concat(F.lit("clip"), clip.cast("string")).alias("video_id"), F.floor(F.col("event_id") / len(FPS)).cast("int").alias("frame_idx"), F.when(clip == 0, FPS[0]).otherwise(FPS[1]).alias("native_fps"), "ts")


def v_patch_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 32 x 32 for the flow kernel: 16 embeddings in a row, each a patch of 8 x 8, make a frame; 20 frames make a clip."""
    emb = table(spark, sf_dir, "embeddings")
    frame, at = F.floor(F.col("vec_id") / 16), F.col("vec_id") % 16
    px = emb.select(frame.alias("frame"), at.alias("at"), F.posexplode("embedding").alias("pos", "e"))
    place = (F.floor(F.col("at") / 4) * 8 + F.floor(F.col("pos") / 8)) * 32 + F.col("at") % 4 * 8 + F.col("pos") % 8
    shade = F.greatest(F.lit(0), F.least(F.lit(255), F.round((F.col("e") + 1) * 127.5))).cast("int")
    gray = px.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), shade.alias("shade")))).alias("p")).where(F.size("p") == 32 * 32)
    bytes_ = F.unhex(F.array_join(F.transform("p", lambda p: F.lpad(F.hex(p["shade"]), 2, "0")), ""))
    index = (F.col("frame") % 20).cast("int")
    return gray.select(F.concat(F.lit("clip"), F.floor(F.col("frame") / 20).cast("string")).alias("video_id"), index.alias("sampled_index"), (index * 6).alias("frame_idx"), (index / 5).alias("timestamp_sec"), F.lit(32).alias("h"), F.lit(32).alias("w"), bytes_.alias("gray"))


def v_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return pages.select(F.floor(F.col("page_id") / 5).cast("long").alias("id"), (F.col("page_id") % 5).cast("int").alias("root_rank"), (F.col("page_id") % 2).cast("int").alias("is_direct"), F.col("url").alias("path"))


def v_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))


_T = "CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 25.0) AS INTEGER)"
_CLIP = "CASE WHEN l_orderkey % 4 = 0 THEN 'clip1' ELSE 'clip0' END"
#: The same views as common table expressions.
SQL = {
    "v_grid": f"SELECT {_CLIP} AS video_id, {_T} AS t, CAST(l_suppkey % 17 AS INTEGER) AS y, CAST(l_partkey % 30 AS INTEGER) AS x, max(l_discount * 10 * l_quantity / 50) AS v FROM lineitem GROUP BY ALL",
    "v_events": f"""SELECT 'clip' || CAST(user_id // {CLIP_USERS} AS VARCHAR) AS video_id, CAST(floor(epoch(ts) / 21600) AS INTEGER) AS t, CAST(user_id % 4 AS INTEGER) AS y, CAST(length(event_type) % 3 AS INTEGER) AS x,
        min_by(value, event_id) AS u, CAST((min(event_id) % 7 - 3) * 15 AS DOUBLE) AS v FROM events GROUP BY ALL""",
    "v_field": """SELECT a.video_id, a.t - min(a.t) OVER (PARTITION BY a.video_id) AS t, b.y, b.x, coalesce(e.u, 0.0) AS u, coalesce(e.v, 0.0) AS v FROM (SELECT DISTINCT video_id, t FROM v_events) a
        JOIN (SELECT DISTINCT video_id, y, x FROM v_events) b ON b.video_id = a.video_id LEFT JOIN v_events e ON e.video_id = a.video_id AND e.t = a.t AND e.y = b.y AND e.x = b.x""",
    "v_sparse": f"""SELECT {_CLIP} AS video_id, {_T} AS t, CAST(l_suppkey % 100 AS INTEGER) AS y, CAST(l_partkey % 200 AS INTEGER) AS x, CAST(max(l_quantity) - 10 AS DOUBLE) AS u, CAST((min(l_tax) * 100 - 4) * 5 AS DOUBLE) AS v FROM lineitem GROUP BY ALL""",
    "v_whole": """SELECT c.video_id, CAST(f.t AS INTEGER) AS t, c.y, c.x, coalesce(s.u, 0.0) AS u, coalesce(s.v, 0.0) AS v FROM (SELECT DISTINCT video_id, y, x FROM v_sparse) c
        JOIN (SELECT video_id, unnest(range(min(t), max(t) + 1)) AS t FROM v_sparse GROUP BY 1) f ON f.video_id = c.video_id LEFT JOIN v_sparse s ON s.video_id = c.video_id AND s.t = f.t AND s.y = c.y AND s.x = c.x""",
    "v_gap": f"""SELECT *, sqrt(u * u + v * v) AS m FROM (SELECT {_CLIP} AS video_id, [1, 5, 10, 20, 50][CAST(l_linenumber % 5 AS INTEGER) + 1] AS gap, {_T} AS t, CAST(l_suppkey % 4 AS INTEGER) AS y, CAST(l_partkey % 4 AS INTEGER) AS x,
        min(l_extendedprice) / 10000 AS u, max(l_tax) * 100 - 4 AS v FROM lineitem GROUP BY ALL)""",
    "v_pixels": f"""SELECT 'clip' || CAST(a.vec_id // {CLIP_PATCHES} AS VARCHAR) AS video_id, CAST(a.vec_id % {CLIP_PATCHES} AS INTEGER) AS t, CAST(p.pos // 8 AS INTEGER) AS y, CAST(p.pos % 8 AS INTEGER) AS x, round((CAST(a.embedding[p.pos + 1] AS DOUBLE) + 1) * 127.5) AS g,
        (CAST(n.embedding[p.pos + 1] AS DOUBLE) - CAST(a.embedding[p.pos + 1] AS DOUBLE)) * 10 AS u, (CAST(n.embedding[(p.pos + 8) % 64 + 1] AS DOUBLE) - CAST(a.embedding[p.pos + 1] AS DOUBLE)) * 10 AS v, abs(CAST(a.embedding[p.pos + 1] AS DOUBLE)) + 0.01 AS w
        FROM embeddings a CROSS JOIN range(64) p(pos) LEFT JOIN embeddings n ON n.vec_id = a.vec_id + 1 AND n.vec_id // {CLIP_PATCHES} = a.vec_id // {CLIP_PATCHES}""",
    "v_rois": "SELECT n_name AS name, CAST(n_nationkey % 6 AS INTEGER) AS x1, CAST(n_nationkey % 5 AS INTEGER) AS y1, CAST(n_nationkey % 6 + 1 + n_nationkey % 4 AS INTEGER) AS x2, CAST(n_nationkey % 5 + n_regionkey AS INTEGER) AS y2 FROM nation",
    "v_frames": "SELECT 'clip' || CAST(event_id % 2 AS VARCHAR) AS video_id, CAST(event_id // 2 AS INTEGER) AS frame_idx, CAST(CASE WHEN event_id % 2 = 0 THEN 30 ELSE 25 END AS DOUBLE) AS native_fps, ts FROM events",
    "v_sampled": "SELECT video_id, frame_idx, CAST(frame_idx // step AS INTEGER) AS i, frame_idx / native_fps AS s FROM (SELECT *, greatest(1, CAST(round_even(native_fps / 5, 0) AS INTEGER)) AS step FROM v_frames) WHERE frame_idx % step = 0",
    "v_candidates": "SELECT page_id // 5 AS id, CAST(page_id % 5 AS INTEGER) AS root_rank, CAST(page_id % 2 AS INTEGER) AS is_direct, url AS path FROM pages",
    "v_lines": "SELECT unnest(string_split(text, chr(10))) AS value FROM documents",
}
