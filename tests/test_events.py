import math
import random

import pytest

from kinegrid.operators import events


def cells(spark, series):
    """series: {(y, x): values}"""
    rows = [("v", t, y, x, float(v)) for (y, x), values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "video_id string, t int, y int, x int, v double")


def found(df):
    return sorted((r.t0, r.t1) for r in df.collect())


def machine(values, high, low, gap):
    """The state machine that the islands stand for."""
    out, start, last = [], None, None
    for t, v in enumerate(values):
        ok = math.isfinite(v)
        if start is not None and t - last > gap + 1:
            out.append((start, last))
            start = None
        if start is None and ok and v >= high:
            start = last = t
        elif start is not None and ok and v >= low:
            last = t
    return out + ([(start, last)] if start is not None else [])


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    ("values", "gap", "want"),
    [
        ([0.5, 0.7, 0.5, 0.4, 0.39, 0.8, 0.8], 0, [(1, 3), (5, 6)]),
        ([0.7, 0.4, 0.4], 0, [(0, 2)]),
        ([0.8, 0, 0.5, 0, 0, 0.5], 1, [(0, 2)]),
        ([0.8, NAN, 0.8], 0, [(0, 0), (2, 2)]),
        ([INF, 0.5, 0.5], 0, []),
        ([], 0, []),
    ],
)
def test_micro_cases(spark, values, gap, want):
    assert found(events.hysteresis_events(cells(spark, {(0, 0): values}), max_gap=gap)) == want


@pytest.mark.parametrize("gap", [0, 1, 2, 5])
def test_equals_state_machine(spark, gap):
    rng = random.Random(gap)
    series = {(y, x): [rng.choice([rng.random(), NAN, INF, 0.4, 0.7]) for _ in range(60)] for y in range(3) for x in range(4)}
    got = events.hysteresis_events(cells(spark, series), max_gap=gap)
    assert sorted((r.y, r.x, r.t0, r.t1) for r in got.collect()) == sorted((y, x, *e) for (y, x), v in series.items() for e in machine(v, 0.7, 0.4, gap))


def test_stored_float_below_threshold(spark):
    df = spark.sql("select 'v' video_id, 0 t, 0 y, 0 x, cast(0.7 as float) v")
    assert found(events.hysteresis_events(df)) == []


def test_ids_count_short_events(spark):
    df = cells(spark, {(0, 0): [0.8, 0, 0.8, 0.8, 0.8], (0, 1): [0.8] * 3})
    assert sorted(r.event_id for r in events.block_events(df).collect()) == [2, 3]


def test_rejects_bad_thresholds(spark):
    with pytest.raises(ValueError):
        events.hysteresis_events(cells(spark, {(0, 0): [1]}), tau_high=0.1, tau_low=0.2)
