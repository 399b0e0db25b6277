"""Archives of maps, and files that are committed."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.plans import stages
from kinegrid.sources import arrays, files, sinks


def stored(tmp_path, name, compressed=False, **maps):
    path = str(tmp_path / f"{name}.npz")
    (np.savez_compressed if compressed else np.savez)(path, **maps)
    return name, path


@pytest.mark.parametrize("compressed", [False, True])
def test_base_maps_by_blocks_of_frames(spark, tmp_path, compressed):
    rng = np.random.default_rng(1)
    u1, m1, u5 = rng.normal(size=(23, 3, 4, 2)).astype(np.float32), rng.random((23, 3, 4)).astype(np.float32), rng.normal(size=(23, 3, 4, 2))
    whole = stored(tmp_path, "a", compressed, U1=u1, M1=m1, U5=u5, P15=m1, stage1_keep=m1 > 0.5, align_start_sampled_index=np.asarray(5, np.int32), num_sampled_frames=np.asarray(28))
    bare = stored(tmp_path, "b", compressed, U1=u1[:1])
    other = stored(tmp_path, "c", compressed, U1=u1, M1=m1[:5])
    none = stored(tmp_path, "d", compressed, M1=m1)
    (tmp_path / "e.npz").write_bytes(b"no archive")
    listed = [whole, bare, other, none, ("e", str(tmp_path / "e.npz")), ("f", str(tmp_path / "gone.npz"))]
    df = arrays.read_base_cells(spark, listed, (1,), block=5)
    assert df.rdd.getNumPartitions() == (5 if not compressed else 1) + 5
    rows = df.collect()
    errors = {r.video_id: r.error for r in rows if r.error}
    assert set(errors) == set("cdef") and errors["c"] == "maps of different shapes" and errors["d"] == "U1 missing"
    got = {(r.t, r.y, r.x): (r.u, r.v, r.m, r.p15, r.keep) for r in rows if r.video_id == "a"}
    assert got == {(t, y, x): (*map(float, u1[t, y, x]), float(m1[t, y, x]), float(m1[t, y, x]), bool(m1[t, y, x] > 0.5)) for t in range(23) for y in range(3) for x in range(4)}
    made = stages.with_magnitude(df.where("video_id = 'b' and error is null")).collect()
    assert len(made) == 12 and all(r.m == pytest.approx(np.hypot(r.u, r.v), rel=1e-6) for r in made)
    five = arrays.read_base_cells(spark, [whole], (1, 5)).where("gap = 5").collect()
    assert len(five) == 276 and all(r.u == np.float32(u5[r.t, r.y, r.x, 0]) and r.m is None for r in five)
    numbers = arrays.read_numbers(spark.createDataFrame([whole, bare], "video_id string, path string")).collect()
    assert {r.video_id: (r.align_start, r.num_sampled, r.width) for r in numbers} == {"a": (5, 28, None), "b": (None, None, None)}


def test_fused_maps_under_older_names(spark, tmp_path):
    m = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    listed = [stored(tmp_path, "new", MU_fused=m, M_fused=m + 100), stored(tmp_path, "max", MU_max=m + 1, MU_median=m), stored(tmp_path, "asked", MU_rms=m, MU_median=m + 2), stored(tmp_path, "cells", M_mean=m + 3)]
    first = lambda df: {r.video_id: r.mu if "mu" in df.columns else r.m for r in df.where("t = 0 and y = 0 and x = 0").collect()}
    df = arrays.read_fused(spark, listed, "median")
    assert first(df) == {"new": 0.0, "max": 0.0, "asked": 2.0} and {r.video_id for r in df.where("error is not null").collect()} == {"cells"}
    assert first(arrays.read_fused(spark, listed[:1] + listed[3:], units=False)) == {"new": 100.0, "cells": 3.0}


@pytest.mark.parametrize("compressed", [False, True])
def test_maps_come_back(spark, tmp_path, compressed):
    rows = [(v, t, y, x, float(t + y), float(x), float(t * y)) for v in ("a", "b/c") for t in (0, 1, 4) for y in range(2) for x in range(3) if (t, x) != (1, 1)]
    cells = spark.createDataFrame(rows, "video_id string, t int, y int, x int, u float, v float, m float").repartition(3)
    numbers = spark.createDataFrame([("a", 7, 0.5), ("b/c", 8, 0.25)], "video_id string, align_start_sampled_index int, input_scale double")
    notes = arrays.write_arrays(cells, str(tmp_path / "out"), {"U1": ("u", "v"), "M1": ("m",)}, numbers, "base", compressed)
    assert sorted((n["video_id"], n["file"], n["frames"], n["error"]) for n in notes) == [("a", "a/a_base.npz", 5, None), ("b/c", "b%2Fc/b%2Fc_base.npz", 5, None)]
    with np.load(tmp_path / "out" / "a" / "a_base.npz") as found:
        assert found["U1"].shape == (5, 2, 3, 2) and found["M1"].shape == (5, 2, 3) and int(found["align_start_sampled_index"]) == 7 and float(found["input_scale"]) == 0.5
    back = arrays.read_base_cells(spark, [(n["video_id"], str(tmp_path / "out" / n["file"])) for n in notes]).collect()
    want = {r[:4]: r[4:] for r in rows}
    assert len(back) == 60 and all((r.u, r.v, r.m) == want.get((r.video_id, r.t, r.y, r.x), (0.0, 0.0, 0.0)) for r in back)
    assert not (tmp_path / "out" / files.TEMPORARY).exists()


def test_a_failing_video_leaves_no_file(spark, tmp_path):
    rows = [(v, t, y, 0, 1.0) for v in "abc" for t in range(3) for y in ((0, -1) if (v, t) == ("b", 1) else (0,))]
    cells = spark.createDataFrame(rows, "video_id string, t int, y int, x int, m float")
    notes = arrays.write_arrays(cells, str(tmp_path / "out"), {"M1": ("m",)})
    assert {n["video_id"]: (n["file"] is None, (n["error"] or "").split(":")[0]) for n in notes} == {"a": (False, ""), "b": (True, "IndexError"), "c": (False, "")}
    assert sorted(p.name for p in (tmp_path / "out").rglob("*.npz")) == ["a_maps.npz", "c_maps.npz"]
    early = spark.createDataFrame([("d", "too few frames: 3")], "video_id string, error string")
    told = sinks.write_summary(spark, str(tmp_path / "out"), notes, early)
    assert json.loads((tmp_path / "out" / "summary.json").read_text()) == told
    assert (told["num_ok"], told["num_failed"]) == (2, 2) and [f["video_id"] for f in told["failed"]] == ["b", "d"]


def test_a_failing_task_leaves_nothing(spark, tmp_path):
    def task(batches, out):
        for batch in batches:
            for value in batch.column(0).to_pylist():
                with out.create(f"part-{value}") as stream:
                    stream.write(b"x")
                if value == 7:
                    raise RuntimeError("broken")
                yield {"value": value}

    at = str(tmp_path / "out")
    with pytest.raises(Exception, match="broken"):
        files.save(spark.range(12).repartition(4), at, task)
    assert not (tmp_path / "out").exists() or not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    done = files.save(spark.range(6).repartition(3), at, task)
    assert done["files"] == [f"part-{i}" for i in range(6)] and sorted(n["value"] for n in done["notes"]) == [*range(6)]
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted([*done["files"], files.COMMITTED])


def test_a_file_for_each_video(spark, tmp_path):
    tracks = spark.createDataFrame([("a", 1, 0), ("a", 2, 3), ("b", 1, 5)], "video_id string, tube_id int, t0 int")
    notes = sinks.write_track_files(tracks, str(tmp_path / "out"))
    assert sorted((n["file"], n["frames"]) for n in notes) == [("a/a_roi_tubes.json", 2), ("b/b_roi_tubes.json", 1)]
    assert json.loads((tmp_path / "out" / "a" / "a_roi_tubes.json").read_text())["num_tubes"] == 2
    assert sinks.write_summary(spark, str(tmp_path / "out"), notes)["written"][0] == {"video_id": "a", "file": "a/a_roi_tubes.json"}
