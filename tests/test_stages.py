import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinegrid.config import Params
from kinegrid.functions import kernels
from kinegrid.operators import frames as fr
from kinegrid.plans import stages
from kinegrid.schemas import FRAMES
from kinegrid.sources import sinks, videos
from kinegrid.streaming.events import stream_events
from kinegrid.operators.events import hysteresis_events


def moving_square(n, h=64, w=96):
    """Frames of a textured square that moves to the right over a still background."""
    rng = np.random.default_rng(2)
    back, patch = kernels.smooth(rng.random((h, w)) * 255, 2), kernels.smooth(rng.random((32, 32)) * 255, 1) * 1.5
    for i in range(n):
        image = back.copy()
        image[16:48, 4 + 2 * i : 36 + 2 * i] = patch
        yield np.clip(image, 0, 255).astype(np.uint8)


def frame_rows(n=16):
    return [("clip", i, i * 6, i / 5, 64, 96, f.tobytes()) for i, f in enumerate(moving_square(n))]


def test_frames_to_tubes(spark):
    params = Params(input_scale=0.5, gaps=(1, 2), gap_divisors={1: 1.0, 2: 2.0}, unit_block=2, min_event=2, min_tube_duration=2, persistence_min=0.5)
    frames = spark.createDataFrame(pd.DataFrame(frame_rows(), columns=["video_id", "sampled_index", "frame_idx", "timestamp_sec", "h", "w", "gray"]), FRAMES)
    cells = stages.base_cells(frames, params)
    assert {(r.gap, r.t) for r in cells.select("gap", "t").distinct().collect()} == {(g, t) for g in (1, 2) for t in range(14)}
    units = stages.unit_cells(stages.fused_cells(cells, params), params)
    tracks = stages.roi_tubes(units, params).collect()
    assert tracks and all(t.num_cells >= 2 for t in tracks)


def test_stored_maps(spark, tmp_path):
    cells = spark.createDataFrame([("b", 1, 0, 0, 0, 3.0, 4.0), ("a", 1, 0, 0, 0, 0.0, 0.0)], "video_id string, gap int, t int, y int, x int, u float, v float")
    sinks.write_map(cells, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert [r.video_id for r in videos.stored_videos(back).collect()] == ["a", "b"]
    assert stages.with_magnitude(back.where("video_id = 'b'")).first().m == 5
    assert "PartitionFilters: [isnotnull(video_id" in back.where("video_id = 'b'")._jdf.queryExecution().toString()


def test_lists_and_files(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# clips\n a \n\nb\na\n")
    assert [r.video_id for r in videos.video_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b", "a"]
    assert [r.video_id for r in videos.video_list(spark, str(tmp_path / "none.txt"), ["z"]).collect()] == ["z"]
    for name in ("one/deep/a.mp4", "two/a.mp4", "two/b.mp4", "one/x/b.mp4", "one/b.mp4"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "video_id string")
    best, missing = videos.resolve(spark, wanted, [str(tmp_path / "one"), str(tmp_path / "two")])
    assert {r.video_id: r.path.split(str(tmp_path))[1] for r in best.collect()} == {"a": "/one/deep/a.mp4", "b": "/one/b.mp4"}
    assert [r.video_id for r in missing.collect()] == ["c"]


def test_frame_source(spark):
    def decoder(path):
        for i in range(25):
            yield i, 12.5, 2, 2, bytes([i] * 4)

    got = videos.read_frames(spark, [("a", "a.mp4"), ("b", "b.mp4")], decoder)
    assert [r.frame_idx for r in got.where("video_id = 'a'").orderBy("frame_idx").collect()] == [*range(0, 25, 2)]  # 2.5 rounds to 2


def counting():
    class Counting:
        """A seeking decoder of made-up frames; a path says how many there are and where it fails."""

        def probe(self, path):
            if path == "closed":
                raise OSError("cannot be opened")
            return 25.0, int(path.split(":")[0]), 96, 64

        def frames(self, path, first, end):
            bad = int(path.split(":")[1]) if ":" in path else None
            for i in range(first, end):
                if i == bad:
                    raise RuntimeError(f"frame {i} is broken")
                yield i, 25.0, 64, 96, bytes([i // 5 % 251]) * (64 * 96)

    return Counting()


def test_long_videos_are_several_partitions(spark):
    df = videos.read_frames(spark, [("long", "1000"), ("short", "30")], counting(), frames_each=103)
    assert df.rdd.getNumPartitions() == 10 + 1  # ranges of whole samples: 100 frames
    got = sorted((r.video_id, r.sampled_index, r.frame_idx, r.timestamp_sec) for r in df.collect())
    assert got == sorted((v, i // 5, i, i / 25) for v, n in (("long", 1000), ("short", 30)) for i in range(0, n, 5))
    part = df.where("video_id in ('long') and timestamp_sec >= 10 and timestamp_sec < 13.9")
    assert part.rdd.getNumPartitions() == 2  # frames 250 to 347
    assert sorted(r.frame_idx for r in part.collect()) == [*range(250, 348, 5)]
    assert df.where("timestamp_sec = 4").count() == 1


def test_a_failing_decoder_is_a_fault_of_its_video(spark):
    """At once, half way, on opening; the others finish, and the error says where."""
    df = videos.read_frames(spark, [("good", "80"), ("late", "80:47"), ("early", "80:0"), ("closed", "closed")], counting(), frames_each=25)
    errors = {r.video_id: (r.error, r.frame_idx) for r in df.where("error is not null").collect()}
    assert errors == {"late": ("RuntimeError: frame 47 is broken", 47), "early": ("RuntimeError: frame 0 is broken", 0), "closed": ("OSError: cannot be opened", 0)}
    assert df.where("video_id = 'late' and error is null").count() == 16  # all samples: the broken frame is none, and other ranges go on
    cells, found = stages.base_and_errors(df, SMALL)
    assert {r.video_id: r.error for r in found.collect()} == {v: e for v, (e, _) in errors.items()}
    assert {r.video_id for r in cells.select("video_id").distinct().collect()} == {"good"}
    tracks, found = stages.run_with_errors(df, SMALL)
    results = stages.results(df, tracks, found)
    summary = sinks.run_summary(results.withColumnRenamed("num_tubes", "num_suppressed")).first()
    assert (summary.num_ok, summary.num_failed) == (1, 3)

    def plain(path):
        for i in range(60):
            if path == "torn" and i == 33:
                raise ValueError("torn")
            yield i, 25.0, 64, 96, bytes(64 * 96)

    df = videos.read_frames(spark, [("torn", "torn"), ("fine", "fine")], plain)
    assert [(r.video_id, r.error, r.frame_idx) for r in df.where("error is not null").collect()] == [("torn", "ValueError: torn", 33)]
    assert df.where("video_id = 'fine'").count() == 12


def test_uncompressed_video_files(spark, tmp_path):
    rng = np.random.default_rng(4)
    gray = rng.integers(0, 256, (40, 5, 7), np.uint8)
    for kind, extra in (("420jpeg", 2 * 4 * 3), ("mono", 0), ("444", 2 * 35)):
        body = b"".join(b"FRAME\n" + g.tobytes() + bytes(extra) for g in gray)
        (tmp_path / f"{kind}.y4m").write_bytes(f"YUV4MPEG2 W7 H5 F30000:1001 Ip C{kind}\n".encode() + body)
    (tmp_path / "cut.y4m").write_bytes((tmp_path / "mono.y4m").read_bytes()[: -41 * 10] + b"FRAMX" + bytes(50))
    (tmp_path / "none.y4m").write_bytes(b"something else")
    names = ["420jpeg", "mono", "444", "cut", "none", "gone"]
    df = videos.read_frames(spark, [(n, str(tmp_path / f"{n}.y4m")) for n in names], videos.Y4m(), fps=15.0, frames_each=10)
    rows = df.collect()
    errors = {r.video_id: r.error for r in rows if r.error}
    assert set(errors) == {"cut", "none", "gone"} and errors["none"] == "ValueError: no YUV4MPEG2 file" and "frame 30" in errors["cut"]
    for name in names[:3]:
        got = sorted((r for r in rows if r.video_id == name), key=lambda r: r.sampled_index)
        assert [r.frame_idx for r in got] == [*range(0, 40, 2)] and all(bytes(r.gray) == gray[r.frame_idx].tobytes() and (r.h, r.w) == (5, 7) for r in got)


def test_half_even_step(spark):
    df = spark.createDataFrame([("v", i, 12.5) for i in range(7)], "video_id string, frame_idx int, native_fps double")
    assert [r.frame_idx for r in fr.sampled(df, 5.0).orderBy("frame_idx").collect()] == [0, 2, 4, 6]


def test_stream_equals_batch(spark, tmp_path):
    values = [0.5, 0.7, 0.5, 0.4, 0.39, 0.8, 0.8, 0, 0, 0, 0, 0, 0, 0, 0]
    rows = [("v", t, 0, 0, float(v)) for t, v in enumerate(values)]
    cells = spark.createDataFrame(rows, "video_id string, t int, y int, x int, v double").selectExpr("*", "timestamp_seconds(t) as ts")
    late = spark.createDataFrame([("v", 100, 9, 9, 0.9)], "video_id string, t int, y int, x int, v double").selectExpr("*", "timestamp_seconds(t) as ts")
    cells.coalesce(1).write.parquet(str(tmp_path / "in"))
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cells.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = stream_events(stream).writeStream.format("memory").queryName("found_events").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.y, r.t0, r.t1) for r in spark.table("found_events").collect()}
    assert got == {(r.y, r.t0, r.t1) for r in hysteresis_events(cells).collect()}


def frame_table(spark, rows):
    return spark.createDataFrame(pd.DataFrame(rows, columns=["video_id", "sampled_index", "frame_idx", "timestamp_sec", "h", "w", "gray"]), FRAMES)


SMALL = Params(input_scale=0.5, gaps=(1, 2), gap_divisors={1: 1.0, 2: 2.0}, unit_block=2, min_event=2, min_tube_duration=2, persistence_min=0.5)


def test_a_broken_video_does_not_end_the_job(spark):
    good = frame_rows()
    torn = [("torn", *r[1:6], r[6][:-1] if r[1] == 3 else r[6]) for r in good]
    short = [("short", *r[1:]) for r in good[:5]]
    holes = [("holes", *r[1:]) for r in good if r[1] != 4]
    frames = frame_table(spark, good + torn + short + holes)
    cells, errors = stages.base_and_errors(frames, SMALL)
    found = {r.video_id: r.error for r in errors.collect()}
    assert set(found) == {"torn", "short", "holes"}
    assert found["torn"] == "1 frames are not of their size" and found["short"] == "too few frames: 5" and found["holes"] == "frames are missing or repeated"
    assert {r.video_id for r in cells.select("video_id").distinct().collect()} == {"clip"}
    tracks, errors = stages.run_with_errors(frames, SMALL)
    results = stages.results(frames, tracks, errors)
    summary = sinks.run_summary(results.withColumnRenamed("num_tubes", "num_suppressed")).first()
    assert (summary.num_ok, summary.num_failed) == (1, 3)
    assert {r.error for r in stages.faults(frame_table(spark, good), Params()).collect()} == {"16 frames for a gap of 50"}


def test_a_failing_kernel_is_a_fault_of_its_video(spark):
    quarter = stages.quarter_frames(frame_table(spark, frame_rows(8) + [("odd", *r[1:]) for r in frame_rows(8)]), SMALL)
    cut = quarter.withColumn("gray", F.when((F.col("video_id") == "odd") & (F.col("sampled_index") == 5), F.expr("substring(gray, 1, 8)")).otherwise(F.col("gray")))
    cells = stages.cell_vectors(cut, SMALL).toPandas()
    assert set(cells[cells.error.notna()].video_id) == {"odd"} and cells.error.dropna().iloc[0].startswith("ValueError")
    assert set(cells[cells.video_id == "clip"].t) == set(range(1, 8))


def test_chunks_of_time_give_each_pair_once(spark):
    rows = [("clip", i, i, i / 5, 16, 16, bytes([(i * 7 + k) % 256 for k in range(256)])) for i in range(140)]
    cells = stages.cell_vectors(stages.quarter_frames(frame_table(spark, rows), Params()), Params())
    got = sorted((r.gap, r.t) for r in cells.where("error is null and y = 0 and x = 0").select("gap", "t").collect())
    assert got == sorted((g, t) for g in Params().gaps for t in range(g, 140))


def test_second_stage_needs_the_first(spark):
    frames = frame_table(spark, frame_rows() + [("none", *r[1:]) for r in frame_rows()] + [("other", *r[1:]) for r in frame_rows()])
    stored = spark.createDataFrame([("clip", 16), ("other", 15)], "video_id string, num_sampled int")
    assert {r.video_id: r.error for r in stages.unmatched(frames, stored).collect()} == {"none": "no stored first stage", "other": "the first stage has 15 frames, the video 16"}


def test_stores_hold_frames_runs_and_gap_maps(spark, tmp_path):
    frames = frame_table(spark, frame_rows())
    cells = stages.base_cells(frames, SMALL)
    sinks.write_stage_one(cells, stages.frame_meta(frames, SMALL), stages.run_meta(frames, SMALL), str(tmp_path / "one"))
    meta = spark.read.parquet(str(tmp_path / "one" / "frame_meta")).where("t = 0").orderBy("gap").collect()
    assert [(r.gap, r.sampled_index_curr, r.sampled_index_prev, r.frame_idx_prev) for r in meta] == [(1, 2, 1, 6), (2, 2, 0, 0)]
    run = spark.read.parquet(str(tmp_path / "one" / "run_meta")).first()
    assert (run.num_sampled, run.align_start, run.cell_rows, run.cell_columns, run.cell_px, list(run.gaps)) == (16, 2, 8, 12, 8, [1, 2])
    fused = stages.fused_cells(cells, SMALL)
    sinks.write_stage_two(fused, stages.unit_cells(fused, SMALL), stages.gap_maps(cells, SMALL), stages.frame_meta(frames, SMALL), stages.run_meta(frames, SMALL), str(tmp_path / "two"))
    maps = spark.read.parquet(str(tmp_path / "two" / "gap_maps")).where("gap = 2 and m > 0").first()
    assert abs(maps.m_norm * 2 - maps.m) < 1e-5
    assert fused.schema["m"].dataType.typeName() == "float"


def test_reliability_by_pixel_and_blurs(spark):
    frames = frame_table(spark, frame_rows(4))
    found = stages.diagnostics(frames, SMALL).toPandas()
    assert set(found.t) == {1, 2, 3} and len(found) == 3 * 32 * 48
    strong = found[found.strong > 0]
    assert np.allclose(strong.penalty, strong.edgeness * strong.alignment**2, atol=1e-5) and np.allclose(found.reliability, np.clip(1 - found.penalty, 0, 1), atol=1e-6)
    blurred = stages.flows_by_blur(frames, SMALL, {"none": None, "two": 2.0}).toPandas()
    assert set(blurred.blur) == {"none", "two"} and len(blurred) == 2 * 3 * 8 * 12


def test_stored_maps_by_name(spark):
    rows = [("a", "m/a_gap_fusion_max.npz"), ("a", "m/a_gap_fusion_rms.npz"), ("b", "m/b_stage3_agg_1.npz"), ("b", "m/b_stage2_agg_2.npz"), ("b", "m/b_stage2_agg_1.npz"), ("c", "m/notes.npz")]
    got = videos.stored_maps(spark.createDataFrame(rows, "video_id string, path string")).collect()
    assert {r.video_id: r.path for r in got} == {"a": "m/a_gap_fusion_rms.npz", "b": "m/b_stage2_agg_1.npz"}


def test_too_few_frames_are_an_error(spark):
    df = spark.createDataFrame([("v", i) for i in range(7)] + [("w", i) for i in range(8)], "video_id string, frame_idx int")
    assert fr.long_enough(df.where("video_id = 'w'")).count() == 8
    with pytest.raises(Exception, match="too few frames in v"):
        fr.long_enough(df).collect()


def test_positions_over_stretches(spark):
    picked = [i for i in range(400) if i % 7 in (0, 3)]
    df = spark.createDataFrame([(v, i) for v in "ab" for i in picked], "video_id string, frame_idx int")
    assert {(r.video_id, r.frame_idx): r.sampled_index for r in fr.renumbered(df, 50).collect()} == {(v, i): k for v in "ab" for k, i in enumerate(picked)}


def test_older_stores_lack_magnitudes_and_runs(spark):
    cells = spark.createDataFrame([("a", 0, 3.0, 4.0), ("b", 0, 0.0, 2.0)], "video_id string, t int, u float, v float")
    bare = {r.video_id: (r.m, r.align_start, r.num_sampled) for r in stages.stored_stage_one(cells).collect()}
    assert bare == {"a": (5.0, 1, None), "b": (2.0, 1, None)}
    runs = spark.createDataFrame([("a", 50)], "video_id string, align_start int")
    assert {r.video_id: (r.align_start, r.num_sampled) for r in stages.stored_stage_one(cells, runs).collect()} == {"a": (50, None), "b": (1, None)}


def test_which_videos_a_run_takes(spark, tmp_path):
    (tmp_path / "list.txt").write_text("# none\na\nb\n")
    names = lambda **given: [r.video_id for r in videos.chosen(spark, **given).collect()]
    store = spark.createDataFrame([("s", 1), ("r", 2), ("s", 3)], "video_id string, t int")
    every = {"ids": ["x", "y"], "one": "z", "path": str(tmp_path / "list.txt"), "stored": store, "fallback": ["f"]}
    assert names(**every) == ["x", "y"]
    assert names(**(every | {"ids": []})) == ["z"]
    assert names(**(every | {"ids": None, "one": ""})) == ["a", "b"]
    assert names(path=str(tmp_path / "gone.txt"), fallback=["f"]) == ["f"]
    assert names(stored=store, fallback=["f"]) == ["r", "s"]
    assert names(stored=store.limit(0), fallback=["f"]) == ["f"]
    with pytest.raises(ValueError, match="no videos"):
        videos.chosen(spark, stored=store.limit(0))


def plain_stages(shots, params):
    """Both first stages in NumPy and loops, on the same flow and reliability kernels."""
    start, out = max(params.gaps), {}
    small = [kernels.area_downscale(s.astype(np.float64), params.input_scale).astype(np.float32) for s in shots]
    ratio = shots[0].shape[1] / small[0].shape[1], shots[0].shape[0] / small[0].shape[0]
    for gap in params.gaps:
        cells = []
        for i in range(gap, len(shots)):
            flow = kernels.dense_flow(small[i - gap], small[i]) * np.array(ratio)
            flow[np.hypot(flow[..., 0], flow[..., 1]) < params.min_magnitude] = 0
            fields = kernels.aperture_fields(small[i], flow, params.tensor_sigma, params.edge_strength, params.align_power, params.aperture_alpha, params.tensor_eps)
            cells.append(kernels.weighted_cells(flow, fields["reliability"], params.cell_stride, params.cell_window).astype(np.float32).astype(np.float64))
        cells = np.array(cells)
        n, back, ahead = len(cells), (params.persistence_window - 1) // 2, params.persistence_window // 2
        gated = np.zeros_like(cells)
        for t in range(n):
            part = cells[max(0, t - back) : t + ahead + 1]
            total, length = np.hypot(part[..., 0], part[..., 1]).sum(axis=0), np.hypot(*np.moveaxis(part.sum(axis=0), -1, 0))
            share = np.where(total > 1e-12, length / np.maximum(total, 1e-12), 0)
            gated[t] = cells[t] * (share >= params.persistence_min)[..., None]
        r = params.mean_radius
        means = np.array([gated[max(0, t - r) : t + r + 1].mean(axis=0) for t in range(n)])
        out[gap] = means[start - gap :] / params.gap_divisors[gap]
    lengths = np.stack([np.hypot(x[..., 0], x[..., 1]) for x in out.values()])
    fused = np.sqrt((lengths**2).mean(axis=0))
    b = params.unit_block
    units = np.array([[[m[y : y + b, x : x + b].max() for x in range(0, m.shape[1], b)] for y in range(0, m.shape[0], b)] for m in fused])
    return out, fused, units


def test_stages_equal_a_plain_model_with_the_usual_gaps(spark):
    rng = np.random.default_rng(6)
    back = kernels.smooth(rng.random((24, 140)) * 255, 1.0)
    shots = [np.clip(np.roll(back, i // 2, axis=1)[:, :40] + rng.normal(size=(24, 40)) * 2, 0, 255).astype(np.uint8) for i in range(64)]
    rows = [("clip", i, i * 6, i / 5, 24, 40, s.tobytes()) for i, s in enumerate(shots)]
    params = Params(input_scale=0.5, unit_block=2)
    assert params.gaps == (1, 5, 10, 20, 50)
    cells = stages.base_cells(frame_table(spark, rows), params)
    maps, fused, units = plain_stages(shots, params)
    got = stages.gap_maps(cells, params).toPandas()
    for gap, want in maps.items():
        one = got[got.gap == gap].sort_values(["t", "y", "x"])
        assert len(one) == want[..., 0].size
        near = np.isclose(one.u_norm.to_numpy().reshape(want.shape[:3]), want[..., 0], atol=1e-4) & np.isclose(one.v_norm.to_numpy().reshape(want.shape[:3]), want[..., 1], atol=1e-4)
        assert near.mean() > 0.995  # a share at the threshold itself may fall either way
    m = stages.fused_cells(cells, params).toPandas().sort_values(["t", "y", "x"]).m.to_numpy().reshape(fused.shape)
    assert np.isclose(m, fused, atol=1e-4).mean() > 0.99 and fused.max() > 0.1
    mu = stages.unit_cells(stages.fused_cells(cells, params), params).toPandas().sort_values(["t", "y", "x"]).mu.to_numpy().reshape(units.shape)
    assert np.isclose(mu, units, atol=1e-4).mean() > 0.98
