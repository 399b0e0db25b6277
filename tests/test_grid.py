"""Grid operators against dense arrays: stencils, windows, sparse series, area means, percentiles by group."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinegrid.functions import kernels
from kinegrid.operators import pixels, spatial, stats, temporal

PIXELS = "video_id string, t int, y int, x int, g double, u double, v double, w double"
CELLS = "video_id string, t int, y int, x int, u double, v double"


def image_rows(rng, frames, h, w):
    values = rng.normal(size=(frames, h, w, 3)) * 10
    weights = rng.random((frames, h, w))
    weights[0, :, : w // 2] = 0
    rows = [("a", t, y, x, *map(float, values[t, y, x]), float(weights[t, y, x])) for t in range(frames) for y in range(h) for x in range(w)]
    return rows, values, weights


def mirrored_sum(image, weights, axis):
    """Weights by offset, along one axis, mirrored."""
    out = np.zeros_like(image)
    n = image.shape[axis]
    for d, weight in weights.items():
        at = np.arange(n) + d
        at = np.where(at < 0, -at, np.where(at >= n, 2 * (n - 1) - at, at))
        out += weight * np.take(image, at, axis=axis)
    return out


@pytest.mark.parametrize("h,w", [(9, 14), (8, 8), (7, 20)])
def test_gradients_and_gaussian(spark, h, w):
    rng = np.random.default_rng(1)
    rows, values, _ = image_rows(rng, 2, h, w)
    df = spark.createDataFrame(rows, PIXELS).repartition(3)
    grads = pixels.gradients(df, h, w)
    got = grads.toPandas().set_index(["t", "y", "x"])
    smooth, change = {-1: 1, 0: 2, 1: 1}, {-1: -1, 1: 1}
    for t in range(2):
        g = values[t, ..., 0]
        ix, iy = mirrored_sum(mirrored_sum(g, change, 1), smooth, 0), mirrored_sum(mirrored_sum(g, smooth, 1), change, 0)
        assert np.allclose(got.loc[t].ix.sort_index().to_numpy().reshape(h, w), ix) and np.allclose(got.loc[t].iy.sort_index().to_numpy().reshape(h, w), iy)
    plan = grads._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "dy" not in plan
    if min(h, w) > 7:
        weights = {i - 6: x for i, x in enumerate(pixels.gaussian_weights(1.5))}
        done = pixels.smoothed(pixels.tensor(grads), h, w).toPandas().set_index(["t", "y", "x"])
        want = mirrored_sum(mirrored_sum(ix * iy, weights, 1), weights, 0)
        assert np.allclose(done.loc[1].jxy.sort_index().to_numpy().reshape(h, w), want)


@pytest.mark.parametrize("h,w,stride,window", [(9, 14, 4, 8), (8, 8, 3, 5), (16, 11, 1, 4), (13, 13, 5, 9)])
def test_window_means(spark, h, w, stride, window):
    rng = np.random.default_rng(2)
    rows, values, weights = image_rows(rng, 2, h, w)
    found = spatial.window_weighted_mean(spark.createDataFrame(rows, PIXELS).repartition(3), h, w, stride, window)
    got = found.toPandas().set_index(["t", "y", "x"])
    mirror = lambda i, n: -i if i < 0 else 2 * (n - 1) - i if i >= n else i
    assert len(got) == 2 * -(-h // stride) * -(-w // stride)
    for (t, cy, cx), row in got.iterrows():
        ys = [mirror(min(cy * stride + stride // 2, h - 1) + d, h) for d in range(-(window // 2), window - window // 2)]
        xs = [mirror(min(cx * stride + stride // 2, w - 1) + d, w) for d in range(-(window // 2), window - window // 2)]
        share = weights[t][np.ix_(ys, xs)]
        for name, k in (("u", 1), ("v", 2)):
            want = (values[t, ..., k][np.ix_(ys, xs)] * share).sum() / share.sum() if share.sum() > 0 else 0.0
            assert row[name] == pytest.approx(want, abs=1e-8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_lines_with_holes(spark):
    """Cells that are missing count nothing and have no row."""
    rng = np.random.default_rng(3)
    rows, values, _ = image_rows(rng, 1, 6, 9)
    rows = [r for r in rows if (r[2] * 9 + r[3]) % 4 != 1]
    g = values[0, ..., 0].copy()
    for y in range(6):
        for x in range(9):
            g[y, x] = 0 if (y * 9 + x) % 4 == 1 else g[y, x]
    got = spatial.convolved(spark.createDataFrame(rows, PIXELS), "x", 9, {"s": ("g", {-2: 1.0, 0: 3.0, 1: -1.0})}).collect()
    want = mirrored_sum(g, {-2: 1.0, 0: 3.0, 1: -1.0}, 1)
    assert len(got) == len(rows) and all(r.s == pytest.approx(want[r.y, r.x]) for r in got)
    sums = spatial.box_sums(spark.createDataFrame(rows, PIXELS), "x", 9, 1, 3, ["g"]).collect()
    want = mirrored_sum(g, {-1: 1.0, 0: 1.0, 1: 1.0}, 1)
    assert len(sums) == 54 and all(r.g == pytest.approx(want[r.y, r.x]) for r in sums)


@pytest.mark.parametrize("h,w,scale", [(7, 10, 0.4), (7, 10, 0.25), (8, 8, 0.5), (5, 3, 1.0), (9, 9, 0.01)])
def test_area_means_of_any_size(spark, h, w, scale):
    rows, values, _ = image_rows(np.random.default_rng(4), 1, h, w)
    got = spatial.area_mean(spark.createDataFrame(rows, PIXELS), h, w, scale).toPandas().set_index(["y", "x"]).g.sort_index()
    want = kernels.area_downscale(values[0, ..., 0], scale)
    assert np.allclose(got.to_numpy().reshape(want.shape), want)


def sparse_rows(seed, share=0.01):
    rng = np.random.default_rng(seed)
    rows = []
    for video, n in (("a", 60), ("b", 4), ("c", 1)):
        for t in range(n):
            for y in range(8):
                for x in range(25):
                    if rng.random() < share or (y, x) == (1, 1) and t % 20 < 4:
                        u, v = ((3.0, 4.0) if y == 1 else map(float, rng.normal(size=2).round(2)))
                        rows.append((video, t + 5, y, x, u, v))
    frames = [("a", t + 5) for t in range(60)] + [("b", t + 5) for t in range(4)] + [("c", 5)]
    return rows, frames


@pytest.mark.parametrize("width,radius", [(15, 2), (4, 0), (1, 7)])
def test_sparse_windows_equal_dense_ones(spark, width, radius):
    rows, frames = sparse_rows(5)
    cells, times = spark.createDataFrame(rows, CELLS), spark.createDataFrame(frames, "video_id string, t int")
    dense = temporal.densify(cells, times, ["u", "v"])
    named = lambda df, *cs: {(r.video_id, r.t, r.y, r.x): tuple(round(r[c], 5) for c in cs) for r in df.collect() if any(round(r[c], 5) for c in cs)}
    series = temporal.series(times)
    assert named(temporal.sparse_persistence(cells, series, width), "p15") == named(temporal.gate(dense, width), "p15")
    got = temporal.sparse_gated_mean(cells, series, width, 0.85, radius)
    assert named(got, "u", "v", "m") == named(temporal.gated_mean(dense, width, 0.85, radius), "u", "v", "m")
    assert got.count() <= len(rows) * (2 * radius + 1) < dense.count() or radius > 2
    whole = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in whole and "Cross" not in whole


def test_percentiles_by_group(spark):
    rng = random.Random(6)
    groups = {"even": [rng.random() for _ in range(3000)], "same": [7.5] * 500, "few": [1.0, 2.0], "one": [-3.0], "wide": [rng.choice((-1, 1)) * 10.0 ** rng.uniform(-300, 300) for _ in range(2000)], "hot": [0.0] * 1500 + [rng.gauss(0, 1) for _ in range(1500)], "huge": [1.7e308, -1.7e308, 0.0, 1.0]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("even", float("nan")), ("even", None), ("one", float("inf")), ("none", None), (None, 2.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    percents = (0.0, 12.5, 50.0, 99.9, 100.0)
    for accuracy in (20,):  # sketches bracket the ranks of most groups
        got = {r.g: r for r in stats.percentiles_by(df, "v", ["g"], percents, accuracy).collect()}
        assert set(got) == set(groups) | {None} or set(got) == set(groups)  # null groups do not join
        for g, vs in groups.items():
            x = sorted(vs)
            for p in percents:
                at = p / 100 * (len(x) - 1)
                low, high = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
                want = low + (high - low) * (at - int(at)) if at > int(at) else low
                assert got[g][f"P{p:g}".replace(".", "_")] == pytest.approx(want, rel=1e-12, abs=1e-300) or np.isinf(high - low)
            assert got[g].n == len(vs)
    every = stats.percentiles(df, "v", (50.0,), 20).first()
    x = sorted([v for vs in groups.values() for v in vs] + [2.0])
    assert every.P50 == pytest.approx((x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2)
    assert np.isnan(stats.percentiles(df.where("g = 'none'"), "v").first().P50)
