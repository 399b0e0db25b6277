"""Registered queries over the derived views, each beside the DuckDB SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import GAP_DIVISORS, GAPS, Params
from .functions.scalars import cells_along, gray, heat_level, sampling_step, scaled_size, suppressed, time_gap
from .functions.storage import materialise, shared_dir
from .operators import events, frames, fusion, overlay, pixels, spatial, stats, temporal, tubes
from .plans import drawing, stages, views
from .sources import arrays, sinks, videos

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
PARAMS = Params()


def query(sql: str | None = None, **ctes: str) -> Callable[[Query], Query]:
    """Registers a query by its function's name. The SQL may use the views and the given common table expressions."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            text = sql + "".join(ctes.values())
            for k, v in reversed(views.SQL.items()):  # a view may use those before it
                text += v if k in text else ""
            used = {k: v for k, v in views.SQL.items() if k in text} | ctes
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {', '.join(f'{k} AS ({v})' for k, v in used.items())} " if used else "") + sql
        return f

    return register


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums may differ in their last digits with their order; a little more than half rounds up in both engines."""
    more = 1e-9 if digits == 6 else 0.0
    return df.select(*((F.round(F.col(c).cast("double") + more, digits) + 0.0).alias(c) if kind in ("double", "float") else F.col(c) for c, kind in df.dtypes))


def r(value: str, name: str | None = None) -> str:
    return f"round(CAST({value} AS DOUBLE) + CAST(1e-9 AS DOUBLE), 6) + 0.0 AS {name or value}"


# --- events ---------------------------------------------------------------------------------------------------------


def _events_sql(gap: int, least: int) -> str:
    return f"""SELECT video_id, event_id, y, x, t0, t1, t1 - t0 + 1 AS duration FROM (
      SELECT video_id, y, x, t0, t1, CAST(row_number() OVER (PARTITION BY video_id ORDER BY y, x, t0) AS INTEGER) AS event_id FROM (
        SELECT video_id, y, x, island, min(t) FILTER (v >= CAST(0.7 AS DOUBLE)) AS t0, max(t) AS t1 FROM (
          SELECT *, sum(fresh) OVER (PARTITION BY video_id, y, x ORDER BY t) AS island FROM (
            SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id, y, x ORDER BY t) <= {gap + 1} THEN 0 ELSE 1 END AS fresh
            FROM v_grid WHERE isfinite(v) AND v >= CAST(0.4 AS DOUBLE)))
        GROUP BY ALL) WHERE t0 IS NOT NULL) WHERE t1 - t0 + 1 >= {least}"""


@query("SELECT * FROM ev", ev=_events_sql(0, 3))
def block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.block_events(views.v_grid(spark, sf_dir))


@query("SELECT * FROM ev", ev=_events_sql(2, 1))
def bridged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events.block_events(views.v_grid(spark, sf_dir), max_gap=2, least=1)


# --- windows --------------------------------------------------------------------------------------------------------

_CELL = "PARTITION BY video_id, y, x ORDER BY t"
_P15 = f"""SELECT *, CAST(CASE WHEN s > CAST(1e-12 AS DOUBLE) THEN greatest(0.0, least(1.0, CAST(CAST(sqrt(su * su + sv * sv) AS FLOAT) AS DOUBLE) / s)) ELSE 0.0 END AS FLOAT) AS p15 FROM (
  SELECT *, sum(CAST(CAST(sqrt(u * u + v * v) AS FLOAT) AS DOUBLE)) OVER w AS s, sum(u) OVER w AS su, sum(v) OVER w AS sv FROM v_field WINDOW w AS ({_CELL} ROWS BETWEEN 7 PRECEDING AND 7 FOLLOWING))"""
_GATE = "SELECT video_id, t, y, x, p15, CAST(p15 AS DOUBLE) >= CAST(0.85 AS DOUBLE) AS keep, CASE WHEN CAST(p15 AS DOUBLE) >= CAST(0.85 AS DOUBLE) THEN u ELSE 0.0 END AS u, CASE WHEN CAST(p15 AS DOUBLE) >= CAST(0.85 AS DOUBLE) THEN v ELSE 0.0 END AS v FROM p"
_MEAN = f"SELECT video_id, t, y, x, p15, keep, CAST(avg(u) OVER w AS FLOAT) AS u, CAST(avg(v) OVER w AS FLOAT) AS v FROM g WINDOW w AS ({_CELL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"


@query(f"SELECT video_id, t, y, x, {r('p15')}, keep, {r('u')}, {r('v')} FROM g", p=_P15, g=_GATE)
def persistence_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = temporal.gate(views.v_field(spark, sf_dir))
    return rounded(out.select("video_id", "t", "y", "x", "p15", "keep", "u", "v"))


@query(f"SELECT video_id, t, y, x, {r('CAST(avg(u) OVER w AS FLOAT)', 'u')}, {r('CAST(avg(v) OVER w AS FLOAT)', 'v')} FROM v_field WINDOW w AS ({_CELL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)")
def moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.moving_mean(views.v_field(spark, sf_dir)))


@query(f"SELECT video_id, t, y, x, keep, {r('u')}, {r('v')}, {r('CAST(sqrt(CAST(u AS DOUBLE) * u + CAST(v AS DOUBLE) * v) AS FLOAT)', 'm')} FROM q", p=_P15, g=_GATE, q=_MEAN)
def gated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.gated_mean(views.v_field(spark, sf_dir)).select("video_id", "t", "y", "x", "keep", "u", "v", "m"))


@query("SELECT video_id, count(*) FILTER (keep) AS n_keep, count(*) FILTER (NOT keep) AS n_reject FROM g GROUP BY video_id", p=_P15, g=_GATE)
def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.gate_counts(temporal.gate(views.v_field(spark, sf_dir)))


@query(f"SELECT video_id, t - 50 AS t, y, x, {r('p15')} FROM g WHERE t >= 50", p=_P15, g=_GATE)
def aligned_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.align(temporal.gate(views.v_field(spark, sf_dir)), 50).select("video_id", "t", "y", "x", "p15"))


@query(f"SELECT video_id, t, y, x, {r('sum(u) OVER (' + _CELL + ' ROWS UNBOUNDED PRECEDING)', 'sum_u')} FROM v_field")
def prefix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(temporal.running_sum(views.v_field(spark, sf_dir), "u").select("video_id", "t", "y", "x", "sum_u"))


@query(f"""SELECT video_id, t, y, x, {r('CASE WHEN sum(w) OVER q > 0 THEN sum(u * w) OVER q / sum(w) OVER q ELSE 0 END', 'u')}, {r('CASE WHEN sum(w) OVER q > 0 THEN sum(v * w) OVER q / sum(w) OVER q ELSE 0 END', 'v')}
  FROM (SELECT *, CAST((t + x) % 3 AS DOUBLE) AS w FROM v_field) WINDOW q AS ({_CELL} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def weighted_moving_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = views.v_field(spark, sf_dir).withColumn("w", ((F.col("t") + F.col("x")) % 3).cast("double"))
    df = temporal.weighted_moving_mean(df.withColumns({"wu": F.col("u") * F.col("w"), "wv": F.col("v") * F.col("w")}), 2)
    return rounded(df.select("video_id", "t", "y", "x", "u", "v"))


@query(f"""SELECT a.video_id, a.y, a.x, b.t, {r('coalesce(g.v, 0)', 'v')} FROM (SELECT DISTINCT video_id, y, x FROM v_grid) a JOIN (SELECT DISTINCT video_id, t FROM v_grid) b ON a.video_id = b.video_id
  LEFT JOIN v_grid g ON g.video_id = a.video_id AND g.y = a.y AND g.x = a.x AND g.t = b.t""")
def densified_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = views.v_grid(spark, sf_dir)
    return rounded(temporal.densify(grid, grid, ["v"]))


@query(f"SELECT video_id, t, y, x, {r('CASE WHEN sqrt(u * u + v * v) < 40 THEN 0.0 ELSE u END', 'u')}, {r('CASE WHEN sqrt(u * u + v * v) < 40 THEN 0.0 ELSE v END', 'v')} FROM v_field")
def suppressed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = suppressed(F.col("u"), F.col("v"), 40.0)
    return rounded(views.v_field(spark, sf_dir).withColumns({"u": u, "v": v}))


_NEAR = {"p": _P15.replace("v_field", "v_whole"), "g": _GATE, "q": _MEAN}


@query("SELECT * FROM (SELECT video_id, t, y, x, " + r("p15") + " FROM p) WHERE p15 > 0", p=_NEAR["p"])
def sparse_persistence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a sparse grid, beside the dense form in SQL, where that is not zero."""
    cells = views.v_sparse(spark, sf_dir)
    return rounded(temporal.sparse_persistence(cells, temporal.series(cells))).where("p15 > 0")


@query(f"SELECT * FROM (SELECT video_id, t, y, x, {r('u')}, {r('v')}, {r('CAST(sqrt(CAST(u AS DOUBLE) * u + CAST(v AS DOUBLE) * v) AS FLOAT)', 'm')} FROM q) WHERE m > 0", **_NEAR)
def sparse_gated_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = views.v_sparse(spark, sf_dir)
    return rounded(temporal.sparse_gated_mean(cells, temporal.series(cells)).select("video_id", "t", "y", "x", "u", "v", "m")).where("m > 0")


# --- blocks and fusion ----------------------------------------------------------------------------------------------


@query(f"SELECT video_id, gap, t, y // 2 AS y, x // 2 AS x, {r('avg(u)', 'u')}, {r('avg(v)', 'v')} FROM v_gap GROUP BY ALL")
def block_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.block_mean(views.v_gap(spark, sf_dir), 2))


@query(f"SELECT video_id, t, y // 4 AS y, x // 4 AS x, {r('CAST(max(v) AS FLOAT)', 'v')} FROM v_grid GROUP BY ALL")
def block_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.block_max(views.v_grid(spark, sf_dir), 4, "v"))


_DIV = "CASE gap " + " ".join(f"WHEN {g} THEN CAST({d} AS DOUBLE)" for g, d in GAP_DIVISORS.items()) + " ELSE CAST(1 AS DOUBLE) END"
_NORM = f"SELECT video_id, gap, t, y, x, CAST(u / {_DIV} AS FLOAT) AS u, CAST(v / {_DIV} AS FLOAT) AS v, CAST(m / {_DIV} AS FLOAT) AS m FROM v_gap"
_EXACT = "SELECT video_id, gap, t, y, x, CAST(u AS DOUBLE) AS u, CAST(v AS DOUBLE) AS v, CAST(m AS DOUBLE) AS m FROM n"


@query(f"SELECT video_id, gap, t, y, x, {r('u')}, {r('v')}, {r('m')} FROM n", n=_NORM)
def normalised_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.normalise(views.v_gap(spark, sf_dir), GAP_DIVISORS)
    return rounded(out.select("video_id", "gap", "t", "y", "x", "u", "v", "m"))


@query(f"SELECT video_id, t, y, x, count(*) AS n_gaps FROM v_gap GROUP BY ALL HAVING count(*) = {len(GAPS)}")
def complete_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.complete(views.v_gap(spark, sf_dir), len(GAPS))


_HOW = {"mean": "avg({0})", "median": "quantile_cont({0}, 0.5)", "rms": "sqrt(avg({0} * {0}))", "max": "max({0})"}


def _fusions() -> None:
    """A query for each way to fuse magnitudes and vectors."""
    for way, how in _HOW.items():

        def magnitudes(spark: SparkSession, sf_dir: str, way: str = way) -> DataFrame:
            return rounded(fusion.fuse_magnitudes(fusion.normalise(views.v_gap(spark, sf_dir), GAP_DIVISORS), way))

        def vectors(spark: SparkSession, sf_dir: str, way: str = way) -> DataFrame:
            return rounded(fusion.fuse_vectors(fusion.normalise(views.v_gap(spark, sf_dir), GAP_DIVISORS), way))

        magnitudes.__name__, vectors.__name__ = f"fused_magnitudes_{way}", f"fused_vectors_{way}"
        query(f"SELECT video_id, t, y, x, {r(f"CAST({how.format('m')} AS FLOAT)", 'm')} FROM d GROUP BY ALL", n=_NORM, d=_EXACT)(magnitudes)
        if way == "max":
            sql = f"SELECT video_id, t, y, x, {r('u')}, {r('v')} FROM (SELECT *, row_number() OVER (PARTITION BY video_id, t, y, x ORDER BY sqrt(u * u + v * v) DESC, gap) AS k FROM d) WHERE k = 1"
        else:
            sign = {"rms": " * CASE WHEN avg({0}) < 0 THEN -1.0 ELSE 1.0 END"}.get(way, "")
            sql = f"SELECT video_id, t, y, x, {r('CAST(' + (how + sign).format('u') + ' AS FLOAT)', 'u')}, {r('CAST(' + (how + sign).format('v') + ' AS FLOAT)', 'v')} FROM d GROUP BY ALL"
        query(sql, n=_NORM, d=_EXACT)(vectors)


_fusions()


@query(f"SELECT v.video_id, v.gap, v.t, v.y, v.x, {r('v.u', 'u')}, {r('v.v', 'v')}, {r('v.m', 'm')}, {r('n.u', 'u_norm')}, {r('n.v', 'v_norm')}, {r('n.m', 'm_norm')} FROM v_gap v JOIN n ON n.video_id = v.video_id AND n.gap = v.gap AND n.t = v.t AND n.y = v.y AND n.x = v.x", n=_NORM)
def gap_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stages.gap_maps(views.v_gap(spark, sf_dir), PARAMS))


# --- frames and files -----------------------------------------------------------------------------------------------


@query(f"SELECT video_id, frame_idx, i AS sampled_index, {r('s', 'timestamp_sec')} FROM v_sampled")
def sampled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = frames.sampled(views.v_frames(spark, sf_dir), 5.0)
    return rounded(out.select("video_id", "frame_idx", "sampled_index", "timestamp_sec"))


@query("SELECT video_id, frame_idx, CAST(row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS INTEGER) AS sampled_index FROM v_sampled")
def renumbered_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.renumbered(frames.sampled(views.v_frames(spark, sf_dir), 5.0).select("video_id", "frame_idx"), 1000)


_PAIRS = "SELECT a.video_id, g.gap, a.i AS sampled_index_curr, a.frame_idx AS frame_idx_curr, a.s AS timestamp_sec_curr, b.i AS sampled_index_prev, b.frame_idx AS frame_idx_prev, b.s AS timestamp_sec_prev FROM v_sampled a CROSS JOIN (SELECT unnest([1, 5, 10, 20, 50]) AS gap) g JOIN v_sampled b ON b.video_id = a.video_id AND b.i = a.i - g.gap"


@query("SELECT video_id, gap, sampled_index_curr, frame_idx_curr, sampled_index_prev, frame_idx_prev FROM pa", pa=_PAIRS)
def gap_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.gap_pairs(frames.sampled(views.v_frames(spark, sf_dir), 5.0), GAPS, ("frame_idx",))


@query(f"SELECT video_id, sampled_index_curr - 50 AS t, gap, sampled_index_curr, frame_idx_curr, {r('timestamp_sec_curr')}, sampled_index_prev, frame_idx_prev, {r('timestamp_sec_prev')} FROM pa WHERE sampled_index_curr >= 50", pa=_PAIRS)
def frame_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stages.frame_meta(frames.sampled(views.v_frames(spark, sf_dir), 5.0), PARAMS))


@query("SELECT CAST(l_orderkey AS VARCHAR) AS video_id, CASE WHEN k IS NULL THEN 'no stored first stage' ELSE 'the first stage has ' || k || ' frames, the video ' || n END AS error FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) LEFT JOIN (SELECT o_orderkey, nullif(o_custkey % 8, 0) AS k FROM orders) ON o_orderkey = l_orderkey WHERE k IS NULL OR k <> n")
def unmatched_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second stages without a first one of as many frames."""
    lines = views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("video_id"))
    stored = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.nullif(F.col("o_custkey") % 8, F.lit(0)).alias("num_sampled"))
    return stages.unmatched(lines, stored)


@query("SELECT id, root_rank, is_direct, path FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY root_rank, is_direct DESC, path) AS k FROM v_candidates) WHERE k = 1")
def best_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.best_files(views.v_candidates(spark, sf_dir))


@query("SELECT trim(value, ' ') AS video_id FROM v_lines WHERE trim(value, ' ') <> '' AND NOT starts_with(trim(value, ' '), '#')")
def listed_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.listed(views.v_lines(spark, sf_dir))


@query("SELECT video_id, count(*) AS n_frames FROM (SELECT CAST(l_orderkey AS VARCHAR) AS video_id FROM lineitem) GROUP BY 1 HAVING count(*) < 4")
def short_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.short_videos(views.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("video_id")), 4)


_KINDS = ("gap_fusion_rms", "gap_fusion_max", "stage2_agg_1", "stage3_agg_2", "notes", "gap_fusion_mean")


@query(
    f"""SELECT video_id, path FROM (SELECT video_id, path, row_number() OVER (PARTITION BY video_id ORDER BY kind, path) AS place FROM (
      SELECT 'v' || p_size AS video_id, 'out/v' || p_size || '/' || p_partkey || '/v' || p_size || '_' || name || '.npz' AS path, CASE WHEN name = 'gap_fusion_rms' THEN 0 WHEN name LIKE 'gap_fusion_%' THEN 1 WHEN name LIKE 'stage2_agg_%' THEN 2 WHEN name LIKE 'stage3_agg_%' THEN 3 END AS kind
      FROM (SELECT *, {list(_KINDS)}[CAST(p_partkey // 7 % 6 AS INTEGER) + 1] AS name FROM part)) WHERE kind IS NOT NULL) WHERE place = 1"""
)
def stored_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, _KINDS)), (F.floor(F.col("p_partkey") / 7) % 6 + 1).cast("int"))
    paths = views.table(spark, sf_dir, "part").select(F.concat(F.lit("v"), "p_size").alias("video_id"), F.concat(F.lit("out/v"), "p_size", F.lit("/"), "p_partkey", F.lit("/v"), "p_size", F.lit("_"), name, F.lit(".npz")).alias("path"))
    return videos.stored_maps(paths)


# --- tubes ----------------------------------------------------------------------------------------------------------

_EV = {"ev": _events_sql(0, 3)}
#: Groups of events, to have many tubes whatever the grid.
_MEM = {**_EV, "mem": "SELECT video_id, CAST(event_id % 40 AS INTEGER) AS tube_id, event_id, y, x, t0, t1 FROM ev"}
_EDGES = "SELECT a.video_id, a.event_id AS a, b.event_id AS b FROM ev a JOIN ev b ON a.video_id = b.video_id AND a.event_id < b.event_id AND greatest(abs(a.y - b.y), abs(a.x - b.x)) BETWEEN 1 AND 2 AND a.t0 <= b.t1 AND b.t0 <= a.t1"
_REACH = "SELECT video_id, event_id AS n, event_id AS m FROM ev UNION SELECT reach.video_id, reach.n, CASE WHEN e.a = reach.m THEN e.b ELSE e.a END FROM reach JOIN edges e ON e.video_id = reach.video_id AND reach.m IN (e.a, e.b)"
_LABEL = "SELECT video_id, n AS event_id, min(m) AS component FROM reach GROUP BY ALL"
_STATS = "SELECT video_id, tube_id, min(t0) AS t0, max(t1) AS t1, CAST(count(DISTINCT y * 1000 + x) AS INTEGER) AS num_cells, CAST(count(*) AS INTEGER) AS num_block_events, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2, max(t1) - min(t0) + 1 AS duration FROM mem GROUP BY video_id, tube_id"


def _block_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(events.block_events(views.v_grid(spark, sf_dir)), "events")


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_events(spark, sf_dir).withColumn("tube_id", (F.col("event_id") % 40).cast("int")).select("video_id", "tube_id", "event_id", "y", "x", "t0", "t1")


@query("SELECT * FROM edges", **_EV, edges=_EDGES)
def neighbour_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.neighbour_edges(_block_events(spark, sf_dir))


@query("SELECT l.video_id, l.event_id AS node, l.component FROM lab l WHERE (l.video_id, l.event_id) IN (SELECT (video_id, a) FROM edges UNION SELECT (video_id, b) FROM edges)", **_EV, edges=_EDGES, reach=_REACH, lab=_LABEL)
def event_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.components(tubes.neighbour_edges(_block_events(spark, sf_dir))).select("video_id", "node", "component")


_RENUMBER = """SELECT m.video_id, CAST(k.new AS INTEGER) AS tube_id, m.event_id, m.y, m.x, m.t0, m.t1 FROM {mem} m JOIN (
    SELECT video_id, tube_id, row_number() OVER (PARTITION BY video_id ORDER BY t0, num_cells DESC, tube_id) AS new FROM {st} WHERE {where}) k ON k.video_id = m.video_id AND k.tube_id = m.tube_id"""
_LARGE = "num_cells >= 2 AND duration >= 3"
_MERGED = {**_EV, "edges": _EDGES, "reach": _REACH, "lab": _LABEL, "mem": "SELECT ev.video_id, lab.component AS tube_id, ev.event_id, ev.y, ev.x, ev.t0, ev.t1 FROM ev JOIN lab ON lab.video_id = ev.video_id AND lab.event_id = ev.event_id", "st": _STATS}


@query(_RENUMBER.format(mem="mem", st="st", where=_LARGE), **_MERGED)
def merged_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.merge_events(_block_events(spark, sf_dir)).select("video_id", "tube_id", "event_id", "y", "x", "t0", "t1")


@query(f"SELECT * FROM (SELECT video_id, t, y, x, {r('CAST(u AS FLOAT)', 'u')}, {r('CAST(v AS FLOAT)', 'v')}, {r('CAST(sqrt(u * u + v * v) AS FLOAT)', 'm')} FROM v_field) WHERE m > 0")
def exchanged_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors written as an archive of arrays for each video, and read back; where they are not zero."""
    path = f"{shared_dir(spark)}/exchange-{uuid.uuid4().hex}"
    field = views.v_field(spark, sf_dir).withColumn("m", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")))
    notes = arrays.write_arrays(field, path, {"U1": ("u", "v"), "M1": ("m",)})
    back = arrays.read_base_cells(spark, [(n["video_id"], f"{path}/{n['file']}") for n in notes])
    return rounded(back.select("video_id", "t", "y", "x", "u", "v", "m")).where("m > 0")


@query("SELECT video_id, tube_id, t0, t1, duration, num_cells, num_block_events, x1, y1, x2, y2 FROM st", **_MEM, st=_STATS)
def tube_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.tube_stats(_members(spark, sf_dir))


@query(
    """SELECT DISTINCT p.video_id, p.a, p.b FROM (SELECT DISTINCT a.video_id, a.tube_id AS a, b.tube_id AS b FROM mem a JOIN mem b ON a.video_id = b.video_id AND a.tube_id < b.tube_id AND greatest(abs(a.y - b.y), abs(a.x - b.x)) <= 2) p
    JOIN st s ON s.video_id = p.video_id AND s.tube_id = p.a JOIN st u ON u.video_id = p.video_id AND u.tube_id = p.b WHERE greatest(0, u.t0 - s.t1 - 1, s.t0 - u.t1 - 1) <= 2""",
    **_EV, mem="SELECT video_id, event_id AS tube_id, event_id, y, x, t0, t1 FROM ev", st=_STATS,
)
def proximity_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = _block_events(spark, sf_dir).withColumn("tube_id", F.col("event_id"))
    return tubes.proximity_edges(members, 2, 2)


_INSIDE = "SELECT DISTINCT i.video_id, i.tube_id FROM st i JOIN st o ON o.video_id = i.video_id AND o.tube_id <> i.tube_id AND o.t0 <= i.t0 AND o.t1 >= i.t1 AND o.x1 <= i.x1 AND o.y1 <= i.y1 AND o.x2 >= i.x2 AND o.y2 >= i.y2 AND NOT (o.t0 = i.t0 AND o.t1 = i.t1 AND o.x1 = i.x1 AND o.y1 = i.y1 AND o.x2 = i.x2 AND o.y2 = i.y2)"


@query(_INSIDE, **_MEM, st=_STATS)
def contained_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.contained(tubes.tube_stats(_members(spark, sf_dir)))


@query("SELECT video_id, tube_id, t, min(x) AS x1, min(y) AS y1, max(x) + 1 AS x2, max(y) + 1 AS y2 FROM (SELECT video_id, tube_id, y, x, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM mem) GROUP BY ALL", **_MEM)
def active_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.active_boxes(_members(spark, sf_dir))


@query(
    """SELECT f.video_id, f.t, f.tube_id, f.x1, f.y1, f.x2, f.y2, CAST(count(DISTINCT a.y * 1000 + a.x) AS INTEGER) AS n_cells FROM (SELECT *, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM st) f
    LEFT JOIN mem a ON a.video_id = f.video_id AND a.tube_id = f.tube_id AND f.t BETWEEN a.t0 AND a.t1 GROUP BY ALL""",
    **_MEM, st=_STATS,
)
def tube_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tubes.overlays(_members(spark, sf_dir))
    return out.select("video_id", "t", "tube_id", *(F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))), F.size("cells").alias("n_cells"))


_SEEN = {k: f"x{k} * CAST({float(-np.sin(np.radians(-60.0)))!r} AS DOUBLE) + t{k} * CAST({float(np.cos(np.radians(-60.0)))!r} AS DOUBLE)" for k in "ab"}
_DEPTH = {k: f"y{k} * CAST({float(np.cos(np.radians(20.0)))!r} AS DOUBLE) - (x{k} * CAST({float(np.cos(np.radians(-60.0)))!r} AS DOUBLE) + t{k} * CAST({float(np.sin(np.radians(-60.0)))!r} AS DOUBLE)) * CAST({float(np.sin(np.radians(20.0)))!r} AS DOUBLE)" for k in "ab"}


@query(
    f"""SELECT video_id, tube_id, event_id, edge, {r(_SEEN['a'], 'x0')}, {r(_DEPTH['a'], 'y0')}, {r(_SEEN['b'], 'x1')}, {r(_DEPTH['b'], 'y1')} FROM (SELECT video_id, tube_id, event_id, CAST(edge AS INTEGER) AS edge,
      {", ".join(f"(x + ({k} >> 2 & 1)) * CAST(64 AS DOUBLE) AS x{k}, CASE WHEN {k} >> 1 & 1 = 0 THEN t0 ELSE t1 + 1 END * CAST(4 AS DOUBLE) AS t{k}, (y + ({k} & 1)) * CAST(64 AS DOUBLE) AS y{k}" for k in "ab")}
      FROM mem CROSS JOIN (VALUES {", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(drawing.EDGES))}) e(edge, a, b))""",
    **_MEM,
)
def prism_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(drawing.prism_lines(_members(spark, sf_dir), 64))


@query("SELECT video_id, tube_id, event_id, CAST((x + i) * 64 AS INTEGER) AS px, CAST(CASE WHEN j = 0 THEN t0 ELSE t1 + 1 END AS INTEGER) AS pt, CAST((y + k) * 64 AS INTEGER) AS py FROM mem CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) CROSS JOIN range(2) c(k)", **_MEM)
def event_prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.prisms(_members(spark, sf_dir), 64)


@query("SELECT video_id, tube_id, CAST(CASE WHEN i = 0 THEN x1 ELSE x2 END * 64 AS INTEGER) AS px, CAST(CASE WHEN j = 0 THEN t0 ELSE t1 + 1 END AS INTEGER) AS pt, CAST(CASE WHEN k = 0 THEN y1 ELSE y2 END * 64 AS INTEGER) AS py FROM st CROSS JOIN range(2) a(i) CROSS JOIN range(2) b(j) CROSS JOIN range(2) c(k)", **_MEM, st=_STATS)
def hull_prisms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.hull_prisms(_members(spark, sf_dir), 64)


@query("SELECT video_id, tube_id, least(x1 * 64, 1920) AS px1, least(y1 * 64, 1080) AS py1, least(x2 * 64, 1920) AS px2, least(y2 * 64, 1080) AS py2, (tube_id + 9) % 10 AS colour FROM st", **_MEM, st=_STATS)
def pixel_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.pixel_boxes(tubes.tube_stats(_members(spark, sf_dir)), 64, 1920, 1080).select("video_id", "tube_id", "px1", "py1", "px2", "py2", "colour")


def _final_sql(rounds: int = 6) -> dict[str, str]:
    """The tubes of `_MERGED`, merged with near ones for so many rounds (more than the test tables need; a round more changes nothing)."""
    out = {**_MERGED, "mem0": _RENUMBER.format(mem="mem", st="st", where=_LARGE)}
    for k in range(1, rounds + 1):
        out[f"st{k}"] = _STATS.replace("FROM mem ", f"FROM mem{k - 1} ")
        out[f"pe{k}"] = f"""SELECT DISTINCT p.video_id, p.a, p.b FROM (SELECT DISTINCT a.video_id, a.tube_id AS a, b.tube_id AS b FROM mem{k - 1} a JOIN mem{k - 1} b ON a.video_id = b.video_id AND a.tube_id < b.tube_id AND greatest(abs(a.y - b.y), abs(a.x - b.x)) <= 2) p
          JOIN st{k} s ON s.video_id = p.video_id AND s.tube_id = p.a JOIN st{k} u ON u.video_id = p.video_id AND u.tube_id = p.b WHERE greatest(0, u.t0 - s.t1 - 1, s.t0 - u.t1 - 1) <= 20"""
        out[f"re{k}"] = f"SELECT video_id, tube_id AS n, tube_id AS m FROM st{k} UNION SELECT r.video_id, r.n, CASE WHEN e.a = r.m THEN e.b ELSE e.a END FROM re{k} r JOIN pe{k} e ON e.video_id = r.video_id AND r.m IN (e.a, e.b)"
        out[f"mem{k}"] = f"SELECT m.video_id, l.least AS tube_id, m.event_id, m.y, m.x, m.t0, m.t1 FROM mem{k - 1} m JOIN (SELECT video_id, n, min(m) AS least FROM re{k} GROUP BY ALL) l ON l.video_id = m.video_id AND l.n = m.tube_id"
    last = f"mem{rounds}"
    out["sta"] = _STATS.replace("FROM mem ", f"FROM {last} ")
    out["near"] = _RENUMBER.format(mem=last, st="sta", where="true")
    out["stb"] = _STATS.replace("FROM mem ", "FROM near ")
    out["large"] = _RENUMBER.format(mem="near", st="stb", where=_LARGE)
    out["stc"] = _STATS.replace("FROM mem ", "FROM large ")
    out["inner_ones"] = _INSIDE.replace(" st ", " stc ")
    out["std"] = "SELECT * FROM stc WHERE (video_id, tube_id) NOT IN (SELECT (video_id, tube_id) FROM inner_ones)"
    return out


_FINAL = _final_sql()


@query("SELECT video_id, tube_id, t0, t1, duration, num_cells, num_block_events, x1, y1, x2, y2 FROM stb", **_FINAL)
def proximity_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.tube_stats(tubes.proximity_merge(tubes.merge_events(_block_events(spark, sf_dir))))


def _final_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tubes.build_tubes(views.v_grid(spark, sf_dir).withColumnRenamed("v", "mu"), PARAMS)


@query(_RENUMBER.format(mem="large", st="std", where="true"), **_FINAL)
def roi_tube_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of events, merging, proximity and containment: the members of the final tubes."""
    return _final_tubes(spark, sf_dir).select("video_id", "tube_id", "event_id", "y", "x", "t0", "t1")


@query()
def roi_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The final tubes as the nested table; `roi_tube_members` has its rows beside SQL."""
    return tubes.tracks(_final_tubes(spark, sf_dir))


_FRAME_CELLS = "SELECT video_id, tube_id, t, list([y, x] ORDER BY y, x) AS cells FROM (SELECT DISTINCT video_id, tube_id, y, x, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM mem) GROUP BY ALL"
_TUBE_ROWS = """SELECT st.video_id, st.tube_id, t0, t1, duration, num_cells, num_block_events, [x1, y1, x2, y2] AS spatial_bbox_grid, m.members, f.per_frame FROM st
  JOIN (SELECT video_id, tube_id, list(struct_pack(event_id := event_id, y := y, x := x, t0 := t0, t1 := t1, duration := t1 - t0 + 1) ORDER BY t0, y, x, event_id) AS members FROM mem GROUP BY ALL) m ON m.video_id = st.video_id AND m.tube_id = st.tube_id
  JOIN (SELECT s.video_id, s.tube_id, list(struct_pack(frame_index := s.t, bbox_grid := [x1, y1, x2, y2], cells := coalesce(c.cells, CAST([] AS INTEGER[][]))) ORDER BY s.t) AS per_frame
    FROM (SELECT *, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM st) s LEFT JOIN fc c ON c.video_id = s.video_id AND c.tube_id = s.tube_id AND c.t = s.t GROUP BY ALL) f ON f.video_id = st.video_id AND f.tube_id = st.tube_id"""


@query(
    """SELECT video_id, CAST(to_json(struct_pack(video_id := video_id, num_tubes := count(*), tubes := list(struct_pack(tube_id := tube_id, t0 := t0, t1 := t1, duration := duration, num_cells := num_cells, num_block_events := num_block_events,
    spatial_bbox_grid := spatial_bbox_grid, members := members, per_frame := per_frame) ORDER BY tube_id))) AS VARCHAR) AS json FROM tr GROUP BY video_id""",
    **_MEM, st=_STATS, fc=_FRAME_CELLS, tr=_TUBE_ROWS,
)
def track_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.track_json(tubes.tracks(_members(spark, sf_dir)))


@query("SELECT count(*) FILTER (n >= 8) AS num_ok, count(*) FILTER (n < 8) AS num_failed, CAST(sum(n % 3) AS BIGINT) AS num_suppressed FROM (SELECT user_id, count(*) AS n FROM events GROUP BY 1)")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return sinks.run_summary(counts.select(F.when(F.col("n") < 8, "too few frames").alias("error"), (F.col("n") % 3).alias("num_suppressed")))


@query("SELECT count(*) FILTER (n >= 60) AS num_ok, count(*) FILTER (n < 60) AS num_failed, array_to_string(list_sort(list(figure) FILTER (n >= 60)), ',') AS images FROM (SELECT 'tubes_' || user_id || '.png' AS figure, count(*) AS n FROM events GROUP BY 1)")
def figure_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "events").groupBy(F.concat(F.lit("tubes_"), "user_id", F.lit(".png")).alias("figure")).agg(F.count("*").alias("n"))
    found = sinks.figure_summary(counts.select("figure", F.when(F.col("n") < 60, "too few frames").alias("error")))
    return found.withColumn("images", F.array_join("images", ","))


# --- pixels ---------------------------------------------------------------------------------------------------------

_REFLECT = "CASE WHEN {0} < 0 THEN -({0}) WHEN {0} > 7 THEN 14 - ({0}) ELSE {0} END"


@query(f"SELECT video_id, t, y // 4 AS y, x // 4 AS x, {r('avg(g)', 'g')} FROM v_pixels GROUP BY ALL")
def downscaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(spatial.downscale(views.v_pixels(spark, sf_dir), 4))


_AT = {axis: _REFLECT.format(f"least({c} * 4 + 2, 7) + {d}") for axis, c, d in (("y", "cy", "dy"), ("x", "cx", "dx"))}


@query(
    f"""SELECT p.video_id, p.t, CAST(c.cy AS INTEGER) AS y, CAST(c.cx AS INTEGER) AS x, {r('sum(w * u) / sum(w)', 'u')}, {r('sum(w * v) / sum(w)', 'v')} FROM (
    SELECT cy, cx, {_AT['y']} AS py, {_AT['x']} AS px FROM range(2) a(cy) CROSS JOIN range(2) b(cx) CROSS JOIN range(-4, 4) d(dy) CROSS JOIN range(-4, 4) e(dx)) c
    JOIN v_pixels p ON p.y = c.py AND p.x = c.px WHERE p.u IS NOT NULL GROUP BY ALL"""
)
def window_weighted_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.v_pixels(spark, sf_dir).where("u is not null")
    return rounded(spatial.window_weighted_mean(px, 8, 8).select("video_id", "t", "y", "x", "u", "v"))


@query(
    f"""SELECT video_id, t, y, x, {r('CASE WHEN sum(w) OVER q > 0 THEN sum(wu) OVER q / sum(w) OVER q ELSE 0 END', 'u')}, {r('CASE WHEN sum(w) OVER q > 0 THEN sum(wv) OVER q / sum(w) OVER q ELSE 0 END', 'v')} FROM (
      SELECT p.video_id, p.t, CAST(c.cy AS INTEGER) AS y, CAST(c.cx AS INTEGER) AS x, sum(w * u) AS wu, sum(w * v) AS wv, sum(w) AS w FROM (
        SELECT cy, cx, {_AT['y']} AS py, {_AT['x']} AS px FROM range(2) a(cy) CROSS JOIN range(2) b(cx) CROSS JOIN range(-4, 4) d(dy) CROSS JOIN range(-4, 4) e(dx)) c
      JOIN v_pixels p ON p.y = c.py AND p.x = c.px WHERE p.u IS NOT NULL GROUP BY ALL) WINDOW q AS (PARTITION BY video_id, y, x ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"""
)
def weighted_sums_over_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted sums of the windows' pixels, added over frames before their ratio is taken."""
    px = views.v_pixels(spark, sf_dir).where("u is not null")
    out = temporal.weighted_moving_mean(spatial.weighted_sums(px, 8, 8), 2)
    return rounded(out.select("video_id", "t", "y", "x", "u", "v"))


_SHARE = "least(({0} + 1) * 3, (c{0} + 1) * 8) - greatest({0} * 3, c{0} * 8)"


@query(f"""SELECT video_id, t, CAST(cy AS INTEGER) AS y, CAST(cx AS INTEGER) AS x, {r('sum(g * s) / sum(s)', 'g')} FROM (SELECT *, ({_SHARE.format('y')}) * ({_SHARE.format('x')}) AS s FROM v_pixels CROSS JOIN range(3) a(cy) CROSS JOIN range(3) b(cx))
  WHERE {_SHARE.format('y')} > 0 AND {_SHARE.format('x')} > 0 GROUP BY ALL""")
def area_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches of 8 x 8 pixels at 3 x 3: a size that the factor does not divide."""
    return rounded(spatial.area_mean(views.v_pixels(spark, sf_dir), 8, 8, 0.4))


@query("SELECT video_id, gap, count(*) AS n, " + ", ".join(r(f"quantile_cont(m, {p / 100})", f"P{p:g}".replace(".", "_")) for p in stats.PERCENTILES) + " FROM v_gap GROUP BY ALL")
def gap_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles of the magnitudes of each video and gap."""
    return rounded(stats.percentiles_by(views.v_gap(spark, sf_dir), "m", ["video_id", "gap"]))


_SOBEL = ", ".join(f"({dy}, {dx}, {kx}, {ky})" for (dy, dx), (kx, ky) in pixels.SOBEL.items())
_GRAD = f"""SELECT c.video_id, c.t, c.y, c.x, CAST(sum(k.kx * n.g) AS DOUBLE) AS ix, CAST(sum(k.ky * n.g) AS DOUBLE) AS iy FROM v_pixels c CROSS JOIN (VALUES {_SOBEL}) k(dy, dx, kx, ky)
  JOIN v_pixels n ON n.video_id = c.video_id AND n.t = c.t AND n.y = {_REFLECT.format('c.y + k.dy')} AND n.x = {_REFLECT.format('c.x + k.dx')} GROUP BY ALL"""
#: The products, averaged by a Gaussian along the rows and then along the columns.
_GAUSS = ", ".join(f"({i - 6}, CAST({w!r} AS DOUBLE))" for i, w in enumerate(pixels.gaussian_weights(PARAMS.tensor_sigma)))


def _smooth_sql(source: str, axis: str, products: tuple[str, str, str]) -> str:
    other = "x" if axis == "y" else "y"
    sums = ", ".join(f"sum(k.w * {p}) AS {name}" for p, name in zip(products, ("jxx", "jyy", "jxy"), strict=True))
    return f"""SELECT c.video_id, c.t, c.y, c.x, {sums} FROM {source} c CROSS JOIN (VALUES {_GAUSS}) k(d, w)
      JOIN {source} n ON n.video_id = c.video_id AND n.t = c.t AND n.{other} = c.{other} AND n.{axis} = {_REFLECT.format(f'c.{axis} + k.d')} GROUP BY ALL"""


_ROWS = _smooth_sql("gr", "x", ("n.ix * n.ix", "n.iy * n.iy", "n.ix * n.iy"))
_TENSOR = _smooth_sql("ro", "y", ("n.jxx", "n.jyy", "n.jxy"))
_EIGEN = "SELECT *, greatest(0.0, (jxx + jyy + q) / 2) AS lambda1, greatest(0.0, (jxx + jyy - q) / 2) AS lambda2 FROM (SELECT *, sqrt(greatest((jxx - jyy) * (jxx - jyy) + 4 * jxy * jxy, 0.0)) AS q FROM te)"
_GT = {"gr": _GRAD, "ro": _ROWS, "te": _TENSOR, "ei": _EIGEN}
#: Eigenvalues are told in units of the square of the largest value.
_UNIT = 255.0 * 255.0


def _tensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.v_pixels(spark, sf_dir)
    products = pixels.tensor(pixels.gradients(px.select("video_id", "t", "y", "x", "g"), 8, 8))
    return pixels.eigenvalues(pixels.smoothed(products, 8, 8, PARAMS.tensor_sigma))


@query(f"SELECT video_id, t, y, x, {r('ix')}, {r('iy')} FROM gr", gr=_GRAD)
def sobel_gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.gradients(views.v_pixels(spark, sf_dir).select("video_id", "t", "y", "x", "g"), 8, 8))


@query(f"SELECT video_id, t, y, x, {r('lambda1 / CAST(65025 AS DOUBLE)', 'lambda1')}, {r('lambda2 / CAST(65025 AS DOUBLE)', 'lambda2')} FROM ei", **_GT)
def tensor_eigenvalues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tensor(spark, sf_dir).select("video_id", "t", "y", "x", (F.col("lambda1") / _UNIT).alias("lambda1"), (F.col("lambda2") / _UNIT).alias("lambda2")))


_TANGENT = """SELECT *, CASE WHEN h1 >= 1e-6 THEN -(lambda1 - jxx) / h1 WHEN h2 >= 1e-6 THEN -jxy / h2 ELSE 1.0 END AS tx, CASE WHEN h1 >= 1e-6 THEN jxy / h1 WHEN h2 >= 1e-6 THEN (lambda1 - jyy) / h2 ELSE 0.0 END AS ty
  FROM (SELECT *, sqrt(jxy * jxy + (lambda1 - jxx) * (lambda1 - jxx)) AS h1, sqrt((lambda1 - jyy) * (lambda1 - jyy) + jxy * jxy) AS h2 FROM ei)"""
_MOTION = "SELECT video_id, t, y, x, u, v FROM v_pixels WHERE u IS NOT NULL"
_APERTURE = """SELECT a.video_id, a.t, a.y, a.x, lambda1, lambda2, m.u, m.v, greatest(0.0, least(1.0, 1 - CASE WHEN lambda1 > 950 THEN (1 - lambda2 / (lambda1 + CAST(1e-6 AS DOUBLE))) *
    pow(CASE WHEN sqrt(m.u * m.u + m.v * m.v) < 1e-6 THEN 0 ELSE greatest(0.0, least(1.0, abs(m.u * tx + m.v * ty) / greatest(sqrt(m.u * m.u + m.v * m.v), 1e-6))) END, 2) ELSE 0.0 END)) AS r
  FROM ta a JOIN mo m ON m.video_id = a.video_id AND m.t = a.t AND m.y = a.y AND m.x = a.x"""


@query(f"SELECT video_id, t, y, x, {r('tx')}, {r('ty')} FROM ta", **_GT, ta=_TANGENT)
def edge_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.tangent(_tensor(spark, sf_dir)).select("video_id", "t", "y", "x", "tx", "ty"))


_FLAT = "SELECT *, CAST(n_nationkey AS DOUBLE) AS jxx, CAST(n_regionkey AS DOUBLE) * 6 AS jyy, CAST(0 AS DOUBLE) AS jxy FROM nation"


@query(f"SELECT n_name AS name, {r('tx')}, {r('ty')} FROM ta", te=_FLAT, ei=_EIGEN, ta=_TANGENT)
def degenerate_tangents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges along the axes and none at all: each branch of the tangent."""
    products = views.table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("jxx"), (F.col("n_regionkey").cast("double") * 6).alias("jyy"), F.lit(0.0).alias("jxy"))
    return rounded(pixels.tangent(pixels.eigenvalues(products)).select("name", "tx", "ty"))


@query(f"SELECT video_id, t, y, x, {r('r')} FROM ap", **_GT, ta=_TANGENT, mo=_MOTION, ap=_APERTURE)
def aperture_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    motion = views.v_pixels(spark, sf_dir).where("u is not null").select("video_id", "t", "y", "x", "u", "v")
    out = pixels.aperture_reliability(pixels.tangent(_tensor(spark, sf_dir)).join(motion, ["video_id", "t", "y", "x"]))
    return rounded(out.select("video_id", "t", "y", "x", "r"))


_REL = "SELECT *, greatest(0.0, least(1.0, shape * strength)) AS r_st FROM (SELECT *, lambda2 / (lambda1 + CAST(1e-6 AS DOUBLE)) AS shape, 1 - exp(-lambda2 / 400) AS strength FROM ei)"


@query(f"SELECT video_id, t, y, x, {r('shape')}, {r('strength')}, {r('r_st')} FROM re", **_GT, re=_REL)
def tensor_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.tensor_reliability(_tensor(spark, sf_dir)).select("video_id", "t", "y", "x", "shape", "strength", "r_st"))


@query("SELECT " + ", ".join(f"{r(f'quantile_cont(lambda2, {p / 100}) / CAST(65025 AS DOUBLE)', f'P{p:g}'.replace('.', '_'))}" for p in stats.PERCENTILES) + " FROM ei WHERE isfinite(lambda2)", **_GT)
def eigenvalue_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = stats.percentiles(materialise(_tensor(spark, sf_dir), "tensor"), "lambda2")
    return rounded(found.select(*((F.col(c) / _UNIT).alias(c) for c in found.columns)))


@query(
    f"""SELECT b.name, b.x1, b.y1, b.x2, b.y2, count(p.y) AS n_pixels, {r('avg(p.lambda1) / CAST(65025 AS DOUBLE)', 'mean_lambda1')}, {r('avg(p.r_st)', 'mean_r_st')}, {r('avg(sqrt(p.u * p.u + p.v * p.v))', 'mean_speed')},
    {r('avg(sqrt(p.u * p.u + p.v * p.v) * p.r_st) / (avg(sqrt(p.u * p.u + p.v * p.v)) + CAST(1e-6 AS DOUBLE))', 'retention')} FROM (SELECT name, least(greatest(x1, 0), 8) AS x1, least(greatest(y1, 0), 8) AS y1, least(greatest(x2, 0), 8) AS x2, least(greatest(y2, 0), 8) AS y2 FROM v_rois) b
    LEFT JOIN (SELECT re.*, m.u, m.v FROM re JOIN mo m ON m.video_id = re.video_id AND m.t = re.t AND m.y = re.y AND m.x = re.x) p ON p.x >= b.x1 AND p.x < b.x2 AND p.y >= b.y1 AND p.y < b.y2 GROUP BY ALL""",
    **_GT, re=_REL, mo=_MOTION,
)
def box_reliability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all frames in each box."""
    motion = views.v_pixels(spark, sf_dir).where("u is not null").select("video_id", "t", "y", "x", "u", "v")
    px = pixels.tensor_reliability(_tensor(spark, sf_dir)).join(motion, ["video_id", "t", "y", "x"])
    found = stats.box_stats(px, views.v_rois(spark, sf_dir), 8, 8).withColumn("mean_lambda1", F.col("mean_lambda1") / _UNIT)
    return rounded(found.select("name", "x1", "y1", "x2", "y2", "n_pixels", "mean_lambda1", "mean_r_st", "mean_speed", "retention"))


@query("SELECT video_id, t, y, x, CAST(round_even(greatest(0.0, least(1.0, (v - lo) / (hi - lo))) * 255, 0) AS INTEGER) AS shade FROM v_grid CROSS JOIN (SELECT min(v) AS lo, quantile_cont(v, 0.99) AS hi FROM v_grid WHERE isfinite(v))")
def display_shades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.for_display(views.v_grid(spark, sf_dir), "v").select("video_id", "t", "y", "x", "shade")


@query(f"SELECT video_id, t, y, x, {r('CASE WHEN v >= CAST(0.2 AS DOUBLE) THEN least(1.0, v / CAST(0.9 AS DOUBLE)) ELSE 0 END', 'level')} FROM v_grid")
def heat_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(views.v_grid(spark, sf_dir).select("video_id", "t", "y", "x", heat_level(F.col("v"), 0.2, 0.9).alias("level")))


@query(f"SELECT video_id, t, y * 4 + dy AS py, x * 4 + dx AS px, {r('v')} FROM v_grid CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS dy) CROSS JOIN (SELECT CAST(unnest(range(4)) AS INTEGER) AS dx) WHERE y * 4 + dy < 66 AND x * 4 + dx < 118")
def expanded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(overlay.expanded(views.v_grid(spark, sf_dir), 4, 66, 118).select("video_id", "t", "py", "px", "v"))


_LEVEL = "SELECT video_id, t, y, x, round_even(CASE WHEN v >= CAST(0.2 AS DOUBLE) THEN least(1.0, v / CAST(0.9 AS DOUBLE)) ELSE 0 END * 255, 0) / CAST(255 AS DOUBLE) AS l FROM v_grid"


def _shade_sql(weights: tuple[float, ...]) -> str:
    out = f"CAST({weights[-1]!r} AS DOUBLE)"
    for w in reversed(weights[:-1]):
        out = f"({out} * l + CAST({w!r} AS DOUBLE))"
    return f"CAST(round_even(greatest(0, least(1, {out})) * 255, 0) AS INTEGER)"


@query("SELECT video_id, t, y, x, " + ", ".join(f"{_shade_sql(w)} AS {k}" for k, w in overlay.TURBO.items()) + " FROM le", le=_LEVEL)
def heat_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = views.v_grid(spark, sf_dir).withColumn("level", heat_level(F.col("v"), 0.2, 0.9))
    return overlay.heat_colours(levels).select("video_id", "t", "y", "x", *overlay.TURBO)


@query("SELECT video_id, t, y, x, CAST(floor(g * (1 - a) + 255 * a) AS INTEGER) AS shade FROM (SELECT *, CASE WHEN w >= CAST(0.05 AS DOUBLE) THEN least(1.0, w / CAST(0.3 AS DOUBLE)) ELSE 0.0 END * CAST(0.75 AS DOUBLE) AS a FROM v_pixels)")
def blended_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlay.blended(views.v_pixels(spark, sf_dir).withColumn("heat", F.lit(255)), "w", 0.05, 0.3).select("video_id", "t", "y", "x", "shade")


@query("SELECT name, fit_w, fit_h, (640 - fit_w) // 2 AS \"left\", (360 - fit_h) // 2 AS top FROM (SELECT name, CAST(greatest(1, round_even(w * s, 0)) AS INTEGER) AS fit_w, CAST(greatest(1, round_even(h * s, 0)) AS INTEGER) AS fit_h FROM (SELECT *, least(CAST(640 AS DOUBLE) / w, CAST(360 AS DOUBLE) / h) AS s FROM (SELECT name, 100 + 37 * x2 AS w, 80 + 53 * y2 AS h FROM v_rois)))")
def letterboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = views.v_rois(spark, sf_dir).select("name", (100 + 37 * F.col("x2")).alias("w"), (80 + 53 * F.col("y2")).alias("h"))
    return overlay.letterboxed(sizes, 640, 360).select("name", "fit_w", "fit_h", "left", "top")


@query("SELECT video_id, t, y, x, round_even(CAST(0.299 AS DOUBLE) * g + CAST(0.587 AS DOUBLE) * (255 - g) + CAST(0.114 AS DOUBLE) * (g / 2), 0) AS shade FROM v_pixels")
def gray_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.v_pixels(spark, sf_dir).select("video_id", "t", "y", "x", gray(F.col("g"), 255 - F.col("g"), F.col("g") / 2).alias("shade"))


@query(f"SELECT video_id, t, y, x, {r('u * (1920 / CAST(480 AS DOUBLE))', 'u')}, {r('v * (1080 / CAST(270 AS DOUBLE))', 'v')} FROM v_field")
def rescaled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = pixels.rescaled(F.col("u"), F.col("v"), 480, 270, 1920, 1080)
    return rounded(views.v_field(spark, sf_dir).withColumns({"u": u, "v": v}))


@query("""SELECT name, CAST(greatest(1, round_even((10 + x2 * 2.5) / 5, 0)) AS INTEGER) AS step, CAST(greatest(1, floor((100 + x2 * 37) * 0.25)) AS INTEGER) AS w, CAST(ceil(greatest(1, floor((100 + x2 * 37) * 0.25)) / 4.0) AS INTEGER) AS cells FROM v_rois""")
def sampling_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    width = scaled_size(100 + F.col("x2") * 37, 0.25)
    return views.v_rois(spark, sf_dir).select("name", sampling_step(10 + F.col("x2") * 2.5, F.lit(5.0)).alias("step"), width.alias("w"), cells_along(width, 4).alias("cells"))


@query(f"SELECT video_id, event_id, greatest(0, n0 - t1 - 1, t0 - n1 - 1) AS gap FROM (SELECT *, lead(t0) OVER w AS n0, lead(t1) OVER w AS n1 FROM ev WINDOW w AS (PARTITION BY video_id, y, x ORDER BY t0)) WHERE n0 IS NOT NULL", ev=_events_sql(2, 1))
def event_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames between each event and the next one of its cell."""
    ev = events.block_events(views.v_grid(spark, sf_dir), max_gap=2, least=1)
    order = Window.partitionBy("video_id", "y", "x").orderBy("t0")
    ev = ev.withColumns({"n0": F.lead("t0").over(order), "n1": F.lead("t1").over(order)}).where("n0 is not null")
    return ev.select("video_id", "event_id", time_gap(F.col("t0"), F.col("t1"), F.col("n0"), F.col("n1")).alias("gap"))


@query("SELECT video_id FROM (SELECT CAST(user_id % 50 AS VARCHAR) AS video_id FROM events) GROUP BY 1")
def stored_videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return videos.stored_videos(views.table(spark, sf_dir, "events").select((F.col("user_id") % 50).cast("string").alias("video_id")))


@query(f"SELECT video_id, t, y // 4 AS y, x // 4 AS x, {r('CAST(max(v) AS FLOAT)', 'mu')} FROM v_grid GROUP BY ALL")
def unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units made of a stored map that holds only cells."""
    return rounded(stages.unit_map(views.v_grid(spark, sf_dir).withColumnRenamed("v", "m"), PARAMS))


@query(f"SELECT video_id, t, y, x, {r('v', 'mu')} FROM v_grid")
def cell_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells themselves, where no units are wanted."""
    return rounded(stages.unit_map(views.v_grid(spark, sf_dir).withColumnRenamed("v", "m"), PARAMS, prefer_unit=False))


@query(f"SELECT video_id, t, y, x, {r('v', 'mu')} FROM v_grid")
def stored_unit_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units that are stored are taken as they are."""
    return rounded(stages.unit_map(views.v_grid(spark, sf_dir).withColumnRenamed("v", "mu").withColumn("m", F.lit(0.0)), PARAMS))


@query("SELECT 'clip' || CAST(frame // 20 AS VARCHAR) AS video_id, CASE WHEN count(*) < 8 THEN 'too few frames: ' || count(*) ELSE count(*) || ' frames for a gap of 50' END AS error FROM (SELECT vec_id // 16 AS frame FROM embeddings GROUP BY 1 HAVING count(*) = 16) GROUP BY frame // 20 HAVING count(*) <= 50")
def frame_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.faults(views.v_patch_frames(spark, sf_dir), PARAMS)


@query("SELECT 'clip' || CAST(frame // 20 AS VARCHAR) AS video_id, CAST(count(*) AS INTEGER) AS num_sampled, 32 AS height, 32 AS width, 2 AS cell_rows, 2 AS cell_columns, 50 AS align_start, 16 AS cell_px, 64 AS unit_px FROM (SELECT vec_id // 16 AS frame FROM embeddings GROUP BY 1 HAVING count(*) = 16) GROUP BY frame // 20")
def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stages.run_meta(views.v_patch_frames(spark, sf_dir), PARAMS)
    return out.select("video_id", "num_sampled", "height", "width", "cell_rows", "cell_columns", "align_start", "cell_px", "unit_px")


@query()
def frame_base_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stage on frames, flow and reliability included: a dense kernel, which SQL does not express."""
    params = Params(gaps=(1, 2), gap_divisors={1: 1.0, 2: 2.0}, input_scale=1.0)
    return stages.base_cells(views.v_patch_frames(spark, sf_dir), params)


@query()
def frame_tubes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three stages, from frames to the nested tubes."""
    params = Params(gaps=(1, 2), gap_divisors={1: 1.0, 2: 2.0}, input_scale=1.0, persistence_min=0.2, min_event=2, min_tube_duration=2, unit_block=2)
    return stages.run(views.v_patch_frames(spark, sf_dir), params)


@query()
def drawn_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tubes of `frame_tubes` and the heat they were found in, drawn on their frames: images, which SQL does not express."""
    shots = views.v_patch_frames(spark, sf_dir)
    params = Params(gaps=(1, 2), gap_divisors={1: 1.0, 2: 2.0}, input_scale=1.0, persistence_min=0.2, min_event=2, min_tube_duration=2, unit_block=2)
    units = materialise(stages.unit_cells(stages.fused_cells(stages.base_cells(shots, params), params), params), "units")
    return drawing.drawn_frames(shots, tubes.build_tubes(units, params), units, params, max(params.gaps), params.cell_stride * params.unit_block)


@query("SELECT o.video_id, o.t, o.tube_id, f.i AS sampled_index_curr FROM (SELECT *, CAST(unnest(range(t0, t1 + 1)) AS INTEGER) AS t FROM st) o JOIN v_sampled f ON f.video_id = o.video_id AND f.i = o.t + 50", **_MEM, st=_STATS)
def overlay_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = frames.sampled(views.v_frames(spark, sf_dir), 5.0).select("video_id", (F.col("sampled_index") - 50).alias("t"), F.col("sampled_index").alias("sampled_index_curr"))
    return frames.overlay_frames(tubes.overlays(_members(spark, sf_dir)), meta).select("video_id", "t", "tube_id", "sampled_index_curr")
