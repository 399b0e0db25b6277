"""Drawn results: tubes and heat on frames, image layers of the first stage, tubes as boxes in space and time.

Images leave the tasks that draw them as rows with BINARY columns, a row for each frame; frames and what is drawn on them meet by
video and chunk of time.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby
from typing import Any
from urllib.parse import quote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Params
from ..functions import raster
from ..operators import tubes
from ..sources.arrays import one_file
from ..sources.files import TaskFiles, save
from . import stages

#: Frames that are drawn as one group.
CHUNK = 64
LAYERS = ("gray", "speed", "lambda1", "edgeness", "strong", "alignment", "penalty", "reliability")


def drawn_frames(frames: DataFrame, members: DataFrame, units: DataFrame, params: Params, start: int, unit: int) -> DataFrame:
    """video_id, t, sampled_index, h, w, rgb (bytes): each frame from `start` on (t = 0), with the heat of its unit cells (column mu) and the
    box and number of each tube that lives at t. `unit` is a unit cell's side in pixels."""
    boxes = tubes.overlays(members).groupBy("video_id", "t").agg(F.array_sort(F.collect_list(F.struct("tube_id", "bbox"))).alias("boxes"))
    heat = units.groupBy("video_id", "t").agg(F.collect_list(F.struct("y", "x", F.col("mu").cast("double").alias("mu"))).alias("heat"))
    marks = boxes.join(heat, ["video_id", "t"], "full").withColumn("chunk", F.floor(F.col("t") / CHUNK))
    timed = frames.where(F.col("sampled_index") >= start).select("video_id", "sampled_index", "h", "w", "gray", (F.col("sampled_index") - start).alias("t")).withColumn("chunk", F.floor(F.col("t") / CHUNK))

    def draw(frames: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        known = {m.t: m for m in marks.itertuples()}
        out = []
        for f in frames.sort_values("t").itertuples():
            image = np.repeat(np.frombuffer(f.gray, np.uint8).reshape(f.h, f.w, 1), 3, axis=2)
            mark = known.get(f.t)
            if mark is not None and mark.heat is not None and len(mark.heat):
                cells = np.full((-(-f.h // unit), -(-f.w // unit)), np.nan)
                for c in mark.heat:
                    if c["y"] < cells.shape[0] and c["x"] < cells.shape[1]:
                        cells[c["y"], c["x"]] = c["mu"]
                image = raster.heated(image, cells, unit, params.heat_min, params.heat_max)
            image = image.copy()
            for b in mark.boxes if mark is not None and mark.boxes is not None else ():
                x1, y1, x2, y2 = (min(v * unit, end) for v, end in zip(b["bbox"], (f.w, f.h, f.w, f.h), strict=True))
                colour = raster.PALETTE[(b["tube_id"] - 1) % len(raster.PALETTE)]
                raster.rectangle(image, (x1, y1, x2, y2), colour)
                raster.label(image, f"T{b['tube_id']}", x1 + 4, y1 + 4, colour)
            out.append((f.video_id, f.t, f.sampled_index, f.h, f.w, image.tobytes()))
        return pd.DataFrame(out, columns=["video_id", "t", "sampled_index", "h", "w", "rgb"])

    keys = ["video_id", "chunk"]
    return timed.groupBy(*keys).cogroup(marks.groupBy(*keys)).applyInPandas(draw, "video_id string, t int, sampled_index int, h int, w int, rgb binary")


def write_overlay_videos(drawn: DataFrame, path: str, fps: float = 5.0, suffix: str = "roi_tubes") -> list[dict[str, Any]]:
    """Writes drawn frames as an uncompressed YUV4MPEG2 video for each video, and returns a note for each: video_id, file, frames, error."""
    rate = f"{round(fps * 1000)}:1000"
    rows = drawn.select("video_id", "t", "h", "w", "rgb").repartition("video_id").sortWithinPartitions("video_id", "t")

    def write(out: pa.NativeFile, rows: Iterator[dict[str, Any]]) -> int:
        size, n = None, 0
        for row in rows:
            if size is None:
                size = row["h"], row["w"]
                out.write(f"YUV4MPEG2 W{size[1]} H{size[0]} F{rate} Ip A1:1 C444\n".encode())
            if size != (row["h"], row["w"]):
                raise ValueError("frames of different sizes")
            out.write(b"FRAME\n" + raster.yuv444(np.frombuffer(row["rgb"], np.uint8).reshape(*size, 3)))
            n += 1
        return n

    def task(batches: Iterator[pa.RecordBatch], files: TaskFiles) -> Iterator[dict[str, Any]]:
        every = (row for batch in batches for i in range(batch.num_rows) for row in batch.slice(i, 1).to_pylist())
        for video, own in groupby(every, key=lambda r: r["video_id"]):
            name = quote(video, safe="")
            yield one_file(files, video, f"{name}/{name}_{suffix}.y4m", own, write)

    return save(rows, path, task)["notes"]


def image_layers(frames: DataFrame, params: Params, gap: int = 1) -> DataFrame:
    """video_id, t, layer, png: what the reliability of each frame's motion is made of, each layer between its least value and its 99th
    percentile as a gray image at the flow's scale."""
    chunks, length = stages._chunks(stages.quarter_frames(frames, params), (gap,))

    def run(chunk: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, i, image, flow in stages._flows(chunk, params, (gap,), length):
            fields = {"gray": image, "speed": np.linalg.norm(flow, axis=-1)} | stages._fields(image, flow, params)
            out += [(chunk["video_id"].iloc[0], i, layer, raster.png(raster.shades(np.asarray(fields[layer], np.float64)))) for layer in LAYERS]
        return pd.DataFrame(out, columns=["video_id", "t", "layer", "png"])

    return chunks.groupBy("video_id", "chunk").applyInPandas(run, "video_id string, t int, layer string, png binary")


#: The twelve edges of a box, by corners (dx, dt, dy).
EDGES = [(a, b) for a in range(8) for b in range(a + 1, 8) if (a ^ b).bit_count() == 1]


def prism_lines(members: DataFrame, unit: int = 1, azimuth: float = -60.0, elevation: float = 20.0, stretch: float = 4.0) -> DataFrame:
    """video_id, tube_id, event_id, edge, and the ends x0, y0, x1, y1 of each edge of each event's box, seen from `azimuth` and `elevation` (degrees);
    a frame is `stretch` pixels long. Rows only: nothing is collected by video."""
    turn, tilt = np.radians(azimuth), np.radians(elevation)
    corner = [(k >> 2 & 1, k >> 1 & 1, k & 1) for k in range(8)]
    edges = F.explode(F.array(*(F.struct(F.lit(i).alias("edge"), *(F.lit(v).alias(n) for n, v in zip(("ax", "at", "ay", "bx", "bt", "by"), (*corner[a], *corner[b]), strict=True))) for i, (a, b) in enumerate(EDGES)))).alias("e")
    rows = members.select("video_id", "tube_id", "event_id", "y", "x", "t0", "t1", edges)

    def seen(end: str):
        px = (F.col("x") + F.col(f"e.{end}x")) * float(unit)
        pt = F.when(F.col(f"e.{end}t") == 0, F.col("t0")).otherwise(F.col("t1") + 1) * float(stretch)
        py = (F.col("y") + F.col(f"e.{end}y")) * float(unit)
        return px * float(-np.sin(turn)) + pt * float(np.cos(turn)), py * float(np.cos(tilt)) - (px * float(np.cos(turn)) + pt * float(np.sin(turn))) * float(np.sin(tilt))

    (x0, y0), (x1, y1) = seen("a"), seen("b")
    return rows.select("video_id", "tube_id", "event_id", F.col("e.edge").alias("edge"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))
