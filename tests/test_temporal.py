import math
import random

import pytest

from kinegrid.config import Params
from kinegrid.operators import fusion, spatial, temporal

SCHEMA = "video_id string, t int, y int, x int, u double, v double"


def series(spark, vectors):
    return spark.createDataFrame([("v", t, 0, 0, float(u), float(v)) for t, (u, v) in enumerate(vectors)], SCHEMA)


def test_persistence(spark):
    get = lambda vectors: [r.p15 for r in temporal.gate(series(spark, vectors)).orderBy("t").collect()]
    assert get([(3, 4)] * 20) == pytest.approx([1] * 20)
    assert max(get([(3, 4), (-3, -4)] * 10)[7:13]) < 0.1
    assert get([(0, 0)] * 5) == [0] * 5


def test_persistence_equals_model(spark):
    rng = random.Random(1)
    vectors = [(rng.gauss(1, 1), rng.gauss(0, 1)) for _ in range(40)]
    for r in temporal.gate(series(spark, vectors)).collect():
        near = vectors[max(0, r.t - 7) : r.t + 8]
        want = math.hypot(sum(a for a, _ in near), sum(b for _, b in near)) / sum(math.hypot(*x) for x in near)
        assert r.p15 == pytest.approx(want, abs=1e-6) and 0 <= r.p15 <= 1
        assert r.keep == (want >= 0.85) and (r.u != 0) == r.keep


def test_mean_at_the_ends(spark):
    got = temporal.moving_mean(series(spark, [(i, 0) for i in range(1, 6)])).orderBy("t").collect()
    assert [r.u for r in got] == [2, 2.5, 3, 3.5, 4]


def test_alignment_follows_windows(spark):
    df = temporal.moving_mean(series(spark, [(i, 0) for i in range(10)]))
    assert [(r.t, r.u) for r in temporal.align(df, 5).orderBy("t").collect()][0] == (0, 5.0)


def test_fusion_with_nan(spark):
    rows = [("v", g, 0, 0, 0, 0.0, 0.0, m) for g, m in ((1, float("nan")), (5, 1.0), (10, 2.0))]
    df = spark.createDataFrame(rows, "video_id string, gap int, t int, y int, x int, u double, v double, m double")
    want = {"mean": 1.5, "max": 2.0, "median": 1.5, "rms": math.sqrt(2.5)}
    assert {w: fusion.fuse_magnitudes(df, w).first().m for w in want} == pytest.approx(want)


def test_vector_ties_and_sign(spark):
    rows = [("v", 1, 0, 0, 0, 3.0, 4.0, 5.0), ("v", 5, 0, 0, 0, -3.0, -4.0, 5.0)]
    df = spark.createDataFrame(rows, "video_id string, gap int, t int, y int, x int, u double, v double, m double")
    best, rms = fusion.fuse_vectors(df, "max").first(), fusion.fuse_vectors(df, "rms").first()
    assert (best.u, best.v) == (3, 4) and (rms.u, rms.v) == (3, 4)


def test_block_max_of_nan(spark):
    df = spark.createDataFrame([("v", 0, 0, x, m) for x, m in enumerate([float("nan"), 1.0, float("nan"), float("nan")])], "video_id string, t int, y int, x int, m double")
    got = {r.x: r.m for r in spatial.block_max(df, 2).collect()}
    assert got[0] == 1 and math.isnan(got[1])


@pytest.mark.parametrize("bad", [{"fusion": "sum"}, {"gaps": (5,)}, {"tau_low": 0.9}, {"max_gap": -1}, {"sampling_fps": 0}, {"neighbour_radius": 0}])
def test_params_are_checked(bad):
    with pytest.raises(ValueError):
        Params(**bad)
