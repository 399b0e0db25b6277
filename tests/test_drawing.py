"""Drawn frames against plain loops over pixels, and files that decode to what was drawn."""

import struct
import sys
import zlib
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from test_stages import SMALL, frame_rows, frame_table

from kinegrid.functions import kernels, raster
from kinegrid.operators import overlay, stats
from kinegrid.plans import drawing, stages
from kinegrid.sources import videos

MEMBERS = "video_id string, tube_id int, event_id int, y int, x int, t0 int, t1 int"


def decoded(data):
    """The image of a PNG file without filters."""
    at, parts, size = 8, b"", None
    while at < len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        assert struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        if kind == b"IHDR":
            size = struct.unpack(">IIBB", body[:10])
        parts += body if kind == b"IDAT" else b""
        at += 12 + n
    w, h, _, kind = size
    rows = np.frombuffer(zlib.decompress(parts), np.uint8).reshape(h, -1)
    assert not rows[:, 0].any()
    return rows[:, 1:].reshape((h, w, 3) if kind == 2 else (h, w))


def plain_frame(gray, heat, boxes, unit, params):
    """The same picture, pixel by pixel."""
    h, w = gray.shape
    out = np.zeros((h, w, 3), int)
    for y in range(h):
        for x in range(w):
            value = heat.get((y // unit, x // unit), float("nan"))
            level = min(1.0, value / params.heat_max) if value >= params.heat_min else 0.0
            step = round(level * 255) / 255
            for k, weights in enumerate(overlay.TURBO.values()):
                shade = round(min(1.0, max(0.0, sum(c * step**i for i, c in enumerate(weights)))) * 255)
                out[y, x, k] = int(gray[y, x] * (1 - level * 0.75) + shade * (level * 0.75) + 1e-9) if heat else gray[y, x]
    for tube, (x1, y1, x2, y2) in boxes:
        colour = raster.PALETTE[(tube - 1) % 10]
        px, py, qx, qy = x1 * unit, y1 * unit, min(x2 * unit, w), min(y2 * unit, h)
        for y in range(py, qy):
            for x in range(px, qx):
                if min(y - py, qy - 1 - y, x - px, qx - 1 - x) < 3:
                    out[y, x] = colour
        for i, sign in enumerate(f"T{tube}"):
            for r in range(10):
                for c in range(6):
                    y, x = py + 4 + r, px + 4 + 8 * i + c
                    if raster.SIGNS[sign][r // 2] >> (2 - c // 2) & 1 and y < h and x < w:
                        out[y, x] = colour
    return out


def test_tubes_and_heat_on_frames(spark, tmp_path):
    rows = frame_rows(12)
    frames = frame_table(spark, rows + [("other", *r[1:]) for r in rows])
    members = [("clip", 1, 1, 0, 1, 0, 3), ("clip", 1, 2, 1, 2, 2, 5), ("clip", 12, 3, 3, 5, 4, 9)]
    heat = [("clip", t, y, x, float(0.3 * (t + y + x))) for t in range(8) for y in range(4) for x in range(6)]
    units = spark.createDataFrame(heat + [("clip", 3, 99, 99, 1.0)], "video_id string, t int, y int, x int, mu double")
    drawn = drawing.drawn_frames(frames, spark.createDataFrame(members, MEMBERS), units, SMALL, 2, 16)
    got = {(r.video_id, r.t): np.frombuffer(r.rgb, np.uint8).reshape(r.h, r.w, 3) for r in drawn.collect()}
    assert set(got) == {(v, t) for v in ("clip", "other") for t in range(10)}
    for t in (0, 3, 5, 9):
        gray = np.frombuffer(rows[t + 2][6], np.uint8).reshape(64, 96)
        boxes = [(1, (1, 0, 3, 2))] * (t <= 5) + [(12, (5, 3, 6, 4))] * (4 <= t <= 9)
        want = plain_frame(gray, {(y, x): m for _, s, y, x, m in heat if s == t}, boxes, 16, SMALL)
        assert np.abs(got["clip", t].astype(int) - want).max() <= 1 and (got["clip", t] == want).mean() > 0.999
        assert (got["other", t] == gray[..., None]).all()
    notes = drawing.write_overlay_videos(drawn, str(tmp_path / "out"))
    assert sorted((n["file"], n["frames"], n["error"]) for n in notes) == [(f"{v}/{v}_roi_tubes.y4m", 10, None) for v in ("clip", "other")]
    back = videos.read_frames(spark, [("clip", str(tmp_path / "out" / "clip" / "clip_roi_tubes.y4m"))], videos.Y4m(), fps=5.0).orderBy("frame_idx").collect()
    assert len(back) == 10
    for r in back:
        luma = np.rint(got["clip", r.frame_idx] @ np.array([0.299, 0.587, 0.114]))
        assert np.abs(np.frombuffer(r.gray, np.uint8).reshape(64, 96) - luma).max() <= 1


def test_layers_are_the_shades_of_their_values(spark):
    frames = frame_table(spark, frame_rows(4))
    found = {(r.t, r.layer): decoded(r.png) for r in drawing.image_layers(frames, SMALL).collect()}
    assert set(found) == {(t, name) for t in (1, 2, 3) for name in drawing.LAYERS}
    values = stages.diagnostics(frames, SMALL).where("t = 2")
    for layer in ("lambda1", "reliability"):
        want = stats.for_display(values, layer).toPandas().sort_values(["y", "x"]).shade.to_numpy().reshape(32, 48)
        assert np.abs(found[2, layer].astype(int) - want).max() <= 1
    assert (raster.shades(np.array([[np.nan, 5.0]])) == 0).all() and (raster.shades(np.full((2, 2), np.inf)) == 0).all()
    image = np.arange(60, dtype=np.uint8).reshape(4, 5, 3)
    assert (decoded(raster.png(image)) == image).all()


def test_boxes_in_space_and_time_as_lines(spark):
    rows = [("v", 1, 1, 2, 3, 0, 4), ("v", 2, 2, 0, 0, 5, 5)]
    lines = drawing.prism_lines(spark.createDataFrame(rows, MEMBERS), unit=10, azimuth=-90.0, elevation=0.0, stretch=2.0).toPandas()
    assert len(lines) == 24 and set(lines.edge) == set(range(12))
    # seen along the axis of time, a box is its square
    one = lines[lines.event_id == 1].round(9)
    assert set(zip(one.x0, one.y0)) | set(zip(one.x1, one.y1)) == {(x, y) for x in (30.0, 40.0) for y in (20.0, 30.0)}
    image = np.zeros((40, 60, 3), np.uint8)
    for r in one.itertuples():
        raster.segment(image, (r.x0, r.y0), (r.x1, r.y1), raster.PALETTE[0])
    assert image[20, 30:41].any(axis=-1).all() and not image[25, 31:40].any()


def test_labels_and_boxes_at_the_edges():
    image = np.zeros((12, 12, 3), np.uint8)
    raster.label(image, "T10", 8, -4, np.array([9, 9, 9], np.uint8))
    raster.rectangle(image, (5, 5, 5, 9), np.array([1, 1, 1], np.uint8))
    assert not (image == 1).any() and (image[:, :8] == 0).all() and image.any()
