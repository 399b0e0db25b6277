import random

import numpy as np
import pytest

from kinegrid.operators import stats


@pytest.mark.parametrize("n", [1, 2, 3, 9, 12, 101, 5000])
@pytest.mark.parametrize("kind", ["spread", "ties", "outlier"])
def test_percentiles_are_exact(spark, n, kind):
    rng = random.Random(n)
    values = {"spread": [rng.gauss(0, 1) for _ in range(n)], "ties": [float(rng.randrange(3)) for _ in range(n)], "outlier": [rng.random() for _ in range(n - 1)] + [1e12]}[kind]
    rows = [(v,) for v in [*values, float("nan"), float("inf"), None]]
    got = stats.percentiles(spark.createDataFrame(rows, "v double").repartition(3), "v", accuracy=100).first()
    assert np.allclose([*got], [np.percentile(values, p) for p in stats.PERCENTILES])


def test_percentiles_of_nothing(spark):
    assert all(x != x for x in stats.percentiles(spark.createDataFrame([(float("nan"),)], "v double"), "v").first())


def test_shades_with_and_without_bounds(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)] + [(float("nan"),)], "v double")
    shades = {r.v: r.shade for r in stats.for_display(df, "v").collect()}
    assert shades[0.0] == 0 and shades[99.0] == shades[100.0] == 255
    assert {r.shade for r in stats.for_display(df, "v", low=0.0, high=50.0).where("v = 50").collect()} == {255}
