"""The three stages as plans: frames -> base cells -> fused and unit cells -> tubes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions import kernels
from ..functions.scalars import magnitude
from ..functions.storage import materialise
from ..operators import fusion, spatial, temporal, tubes
from ..operators import frames as fr

_DIAGNOSTICS = ("lambda1", "lambda2", "edgeness", "strong", "alignment", "penalty", "reliability")


def faults(frames: DataFrame, params: Params, least: int = 8) -> DataFrame:
    """video_id, error for the videos that no stage can take: a fault of its decoder (the first one, if `frames` has a column error), a
    frame whose bytes are not of its size, sizes or numbers that do not go together, or too few frames for a stage or for the
    largest gap."""
    if "error" in frames.columns:
        failed = frames.where("error is not null").groupBy("video_id").agg(F.min_by("error", "frame_idx").alias("error"))
        return failed.union(faults(without(frames.where("error is null").drop("error"), failed), params, least))
    n, last = F.count("*"), F.max("sampled_index")
    bad = F.count_if(F.col("gray").isNull() | (F.length("gray") != F.col("h") * F.col("w")))
    stats = frames.groupBy("video_id").agg(n.alias("n"), F.min("sampled_index").alias("first"), last.alias("last"), bad.alias("bad"), (F.max("h") - F.min("h") + F.max("w") - F.min("w")).alias("sizes"))
    gap = max(params.gaps)
    error = (
        F.when(F.col("bad") > 0, F.concat(F.col("bad").cast("string"), F.lit(" frames are not of their size")))
        .when(F.col("sizes") > 0, "frames of different sizes")
        .when((F.col("first") != 0) | (F.col("last") != F.col("n") - 1), "frames are missing or repeated")
        .when(F.col("n") < least, F.concat(F.lit("too few frames: "), F.col("n").cast("string")))
        .when(F.col("n") <= gap, F.concat(F.col("n").cast("string"), F.lit(f" frames for a gap of {gap}")))
    )
    return stats.select("video_id", error.alias("error")).where(F.col("error").isNotNull())


def unmatched(frames: DataFrame, stored: DataFrame) -> DataFrame:
    """video_id, error for the videos whose stored first stage is missing or was made of another number of frames. `stored` has
    video_id and num_sampled, a row for each video."""
    now = frames.groupBy("video_id").agg(F.count("*").alias("n"))
    both = now.join(stored.select("video_id", "num_sampled"), "video_id", "left")
    error = F.when(F.col("num_sampled").isNull(), "no stored first stage").when(F.col("num_sampled") != F.col("n"), F.format_string("the first stage has %d frames, the video %d", F.col("num_sampled"), F.col("n")))
    return both.select("video_id", error.alias("error")).where(F.col("error").isNotNull())


def without(df: DataFrame, errors: DataFrame) -> DataFrame:
    """The rows of the videos that have no error."""
    return df.join(errors.select("video_id"), "video_id", "left_anti")


def quarter_frames(frames: DataFrame, params: Params, blurs: dict[str, float | None] | None = None) -> DataFrame:
    """Frames at the flow's scale, h and w of that scale, full_h and full_w of the original. Frames stay one row each; one that
    cannot be scaled has no gray, and `error`. With `blurs` a frame is read once and has a row for each named one, which
    smooths it first; the name is in the column blur."""

    def scaled(gray: bytes, h: int, w: int, blur: float | None) -> tuple[int | None, int | None, bytes | None, str | None]:
        try:
            whole = np.frombuffer(gray, np.uint8).reshape(h, w).astype(np.float64)
            small = kernels.area_downscale(kernels.smooth(whole, blur) if blur else whole, params.input_scale)
            return *small.shape, small.astype(np.float32).tobytes(), None
        except Exception as e:  # whatever a kernel raises is a fault of this video alone
            return None, None, None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, blur in (blurs or {None: None}).items():
                small = pd.DataFrame([scaled(*r, blur) for r in zip(batch["gray"], batch["h"], batch["w"], strict=True)], columns=["h", "w", "gray", "error"], index=batch.index)
                out = batch[["video_id", "sampled_index", "frame_idx", "timestamp_sec"]].assign(full_h=batch["h"], full_w=batch["w"])
                out = out.join(small.astype({"h": "Int32", "w": "Int32"}))
                yield out.assign(blur=name) if blurs else out

    kinds = "video_id string, sampled_index int, frame_idx int, timestamp_sec double, full_h int, full_w int, h int, w int, gray binary, error string"
    return frames.drop("error").mapInPandas(run, kinds + ", blur string" if blurs else kinds)


def _flows(chunk: pd.DataFrame, params: Params, gaps: tuple[int, ...], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(gap, index, image, flow) of the frames that a chunk owns."""
    held = {r.sampled_index: (np.frombuffer(r.gray, np.float32).reshape(r.h, r.w), r.full_w / r.w, r.full_h / r.h) for r in chunk.itertuples()}
    for i in sorted(held):
        if i // length == chunk["chunk"].iloc[0]:
            for gap in gaps:
                if i - gap in held:
                    image, x, y = held[i]
                    flow = kernels.dense_flow(held[i - gap][0], image) * np.array([x, y])
                    flow[np.linalg.norm(flow, axis=-1) < params.min_magnitude] = 0
                    yield gap, i, image, flow


def _fields(image: np.ndarray, flow: np.ndarray, params: Params) -> dict[str, np.ndarray]:
    return kernels.aperture_fields(image, flow, params.tensor_sigma, params.edge_strength, params.align_power, params.aperture_alpha, params.tensor_eps)


def _chunks(quarter: DataFrame, gaps: tuple[int, ...]) -> tuple[DataFrame, int]:
    """Frames by chunks of time: a frame goes to its own chunk, and to the next if a frame there looks back at it."""
    length = max(64, 2 * max(gaps))
    return quarter.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("sampled_index") / length), F.floor((F.col("sampled_index") + max(gaps)) / length)))), length


def cell_vectors(quarter: DataFrame, params: Params, gaps: tuple[int, ...] | None = None) -> DataFrame:
    """One row for each cell of each frame and gap: only cells leave the kernel, never pixels. A video in which the kernel
    fails has a row with `error` and without a cell instead of ending the job."""
    gaps = gaps or params.gaps
    chunks, length = _chunks(quarter, gaps)
    more = [c for c in ("blur",) if c in quarter.columns]
    names = ["video_id", "gap", "t", "y", "x", "u", "v", "error", *more]

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        own, parts = {c: chunk[c].iloc[0] for c in ("video_id", *more)}, []
        try:
            if chunk["error"].notna().any():
                return pd.DataFrame([own | {"error": chunk["error"].dropna().iloc[0]}]).reindex(columns=names)
            for gap, i, image, flow in _flows(chunk, params, gaps, length):
                cells = kernels.weighted_cells(flow, _fields(image, flow, params)["reliability"], params.cell_stride, params.cell_window).astype(np.float32)
                y, x = (a.ravel() for a in np.indices(cells.shape[:2], np.int32))
                parts.append(pd.DataFrame(own | {"gap": np.int32(gap), "t": np.int32(i), "y": y, "x": x, "u": cells[..., 0].ravel(), "v": cells[..., 1].ravel(), "error": None}))
        except Exception as e:  # whatever a kernel raises is a fault of this video alone
            parts = [pd.DataFrame([own | {"error": f"{type(e).__name__}: {e}"}])]
        return pd.concat(parts).reindex(columns=names) if parts else pd.DataFrame(columns=names)

    kinds = "video_id string, gap int, t int, y int, x int, u float, v float, error string"
    return chunks.groupBy("video_id", *more, "chunk").applyInPandas(run, kinds + "".join(f", {c} string" for c in more))


def diagnostics(frames: DataFrame, params: Params, gap: int = 1) -> DataFrame:
    """video_id, gap, t, y, x and what the reliability of each pixel at the flow's scale is made of."""
    chunks, length = _chunks(quarter_frames(frames, params), (gap,))

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        parts = []
        for g, i, image, flow in _flows(chunk, params, (gap,), length):
            y, x = (a.ravel() for a in np.indices(image.shape, np.int32))
            fields = {k: v.ravel().astype(np.float32) for k, v in _fields(image, flow, params).items()}
            parts.append(pd.DataFrame({"video_id": chunk["video_id"].iloc[0], "gap": np.int32(g), "t": np.int32(i), "y": y, "x": x} | fields))
        return pd.concat(parts) if parts else pd.DataFrame(columns=["video_id", "gap", "t", "y", "x", *_DIAGNOSTICS])

    kinds = ", ".join(f"{k} float" for k in _DIAGNOSTICS)
    return chunks.groupBy("video_id", "chunk").applyInPandas(run, f"video_id string, gap int, t int, y int, x int, {kinds}")


def flows_by_blur(frames: DataFrame, params: Params, blurs: dict[str, float | None], gap: int = 1) -> DataFrame:
    """Cell vectors once for each named blur of the frames, with its name; frames are read once."""
    return cell_vectors(quarter_frames(frames, params, blurs), params, (gap,)).where("error is null").drop("error")


def base_cells(frames: DataFrame, params: Params, gaps: tuple[int, ...] | None = None, start: int | None = None) -> DataFrame:
    """Gated, smoothed cell vectors for each gap, aligned so that t = 0 is the first frame that every gap has; of videos
    without a fault."""
    return base_and_errors(frames, params, gaps, start)[0]


def base_and_errors(frames: DataFrame, params: Params, gaps: tuple[int, ...] | None = None, start: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(base cells of the videos that went well; video_id, error of the others)."""
    gaps = gaps or params.gaps
    early = materialise(faults(frames, params), "faults")
    good = without(frames.where("error is null") if "error" in frames.columns else frames, early)
    found = materialise(cell_vectors(quarter_frames(good, params), params, gaps), "vectors")
    late = found.where("error is not null").groupBy("video_id").agg(F.min("error").alias("error"))
    cells = without(found.where("error is null").drop("error"), late)
    cells = temporal.gated_mean(cells, params.persistence_window, params.persistence_min, params.mean_radius)
    return temporal.align(cells, max(gaps) if start is None else start), early.union(late)


def frame_meta(frames: DataFrame, params: Params, gaps: tuple[int, ...] | None = None, start: int | None = None) -> DataFrame:
    """video_id, t, gap, and index, frame and time of the current frame and of the one `gap` before it: what each map was made of."""
    gaps = gaps or params.gaps
    start = max(gaps) if start is None else start
    pairs = fr.gap_pairs(frames, gaps).where(F.col("sampled_index_curr") >= start)
    return pairs.select("video_id", (F.col("sampled_index_curr") - start).alias("t"), *(c for c in pairs.columns if c != "video_id"))


def run_meta(frames: DataFrame, params: Params, gaps: tuple[int, ...] | None = None, start: int | None = None) -> DataFrame:
    """One row for each video: the number of its frames, its grids, and the parameters of the run."""
    gaps = gaps or params.gaps
    scaled = lambda c: F.greatest(F.lit(1), F.floor(F.max(c) * params.input_scale).cast("int"))
    size = frames.groupBy("video_id").agg(F.count("*").cast("int").alias("num_sampled"), F.max("h").alias("height"), F.max("w").alias("width"), F.ceil(scaled("h") / params.cell_stride).cast("int").alias("cell_rows"), F.ceil(scaled("w") / params.cell_stride).cast("int").alias("cell_columns"))
    cell = round(params.cell_stride / params.input_scale)
    known = {"gaps": F.array(*map(F.lit, gaps)), "align_start": F.lit(max(gaps) if start is None else start), "cell_px": F.lit(cell), "unit_px": F.lit(cell * params.unit_block)}
    return size.withColumns(known | {k: F.lit(getattr(params, k)) for k in ("sampling_fps", "input_scale", "min_magnitude", "cell_stride", "cell_window", "mean_radius", "persistence_window", "persistence_min", "unit_block", "fusion")})


def gap_maps(cells: DataFrame, params: Params) -> DataFrame:
    """The map of each gap, raw and over its divisor: video_id, gap, t, y, x, u, v, m, u_norm, v_norm, m_norm."""
    keys = ["video_id", "gap", "t", "y", "x"]
    raw = cells.withColumns({f"{c}_raw": F.col(c) for c in ("u", "v", "m")})
    even = fusion.normalise(raw, {g: params.gap_divisors.get(g, 1.0) for g in params.gaps})
    return even.select(*keys, *(F.col(f"{c}_raw").alias(c) for c in ("u", "v", "m")), *(F.col(c).alias(f"{c}_norm") for c in ("u", "v", "m")))


def fused_cells(cells: DataFrame, params: Params) -> DataFrame:
    """video_id, t, y, x, m, u, v over the cells that all gaps have."""
    even = fusion.normalise(cells, {g: params.gap_divisors.get(g, 1.0) for g in params.gaps})
    whole = fusion.complete(even, len(params.gaps)).drop("n_gaps")
    even = even.join(whole, [*fusion.KEYS])
    return fusion.fuse_magnitudes(even, params.fusion).join(fusion.fuse_vectors(even, params.fusion), [*fusion.KEYS])


def unit_cells(fused: DataFrame, params: Params) -> DataFrame:
    """video_id, t, y, x, mu, uu, uv: block maxima of the magnitude and block means of the vector."""
    m = spatial.block_max(fused, params.unit_block).withColumnRenamed("m", "mu")
    v = spatial.block_mean(fused, params.unit_block).select("video_id", "t", "y", "x", F.col("u").cast("float").alias("uu"), F.col("v").cast("float").alias("uv"))
    return m.join(v, ["video_id", "t", "y", "x"])


def roi_tubes(units: DataFrame, params: Params) -> DataFrame:
    return tubes.tracks(tubes.build_tubes(units, params))


def unit_map(stored: DataFrame, params: Params, prefer_unit: bool = True) -> DataFrame:
    """The map that tubes are built on: stored unit cells, else units made of fused cells, or these themselves."""
    if "mu" in stored.columns:
        return stored.select("video_id", "t", "y", "x", "mu")
    if prefer_unit:
        return spatial.block_max(stored.select("video_id", "t", "y", "x", "m"), params.unit_block).withColumnRenamed("m", "mu")
    return stored.select("video_id", "t", "y", "x", F.col("m").alias("mu"))


def with_magnitude(cells: DataFrame) -> DataFrame:
    """Stored base cells, m made from the vector where it is missing."""
    m = F.col("m") if "m" in cells.columns else F.lit(None)
    return cells.withColumn("m", F.coalesce(m, magnitude(F.col("u"), F.col("v"))).cast("float"))


def stored_stage_one(cells: DataFrame, run_meta: DataFrame | None = None) -> DataFrame:
    """Stored base cells with what older stores lack: m from the vector, align_start (1 where the run says none), num_sampled (null
    where the run says none)."""
    out = with_magnitude(cells)
    if run_meta is None:
        return out.withColumns({"align_start": F.lit(1), "num_sampled": F.lit(None).cast("int")})
    known = {c: F.col(c) if c in run_meta.columns else F.lit(None) for c in ("align_start", "num_sampled")}
    runs = run_meta.select("video_id", *(v.cast("int").alias(c) for c, v in known.items()))
    return out.join(runs, "video_id", "left").withColumn("align_start", F.coalesce("align_start", F.lit(1)))


def run(frames: DataFrame, params: Params | None = None) -> DataFrame:
    """The nested tubes of all videos without a fault."""
    return run_with_errors(frames, params)[0]


def run_with_errors(frames: DataFrame, params: Params | None = None) -> tuple[DataFrame, DataFrame]:
    """(nested tubes; video_id, error of the videos that have none because of a fault)."""
    params = params or Params()
    cells, errors = base_and_errors(frames, params)
    return roi_tubes(unit_cells(fused_cells(cells, params), params), params), errors


def results(frames: DataFrame, tracks: DataFrame, errors: DataFrame) -> DataFrame:
    """A row for each video: video_id, error (null if it went well), num_tubes. `sinks.run_summary` counts them."""
    found = tracks.groupBy("video_id").agg(F.count("*").alias("num_tubes"))
    out = frames.select("video_id").distinct().join(errors, "video_id", "left").join(found, "video_id", "left")
    return out.select("video_id", "error", F.coalesce("num_tubes", F.lit(0)).alias("num_tubes"))
