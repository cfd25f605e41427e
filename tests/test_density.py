import math

import numpy as np
import pytest

from anchorloom.operators import density


def direct(values, points=200, cut=3.0, width=None):
    v = np.array(values, float)
    w = width or v.std(ddof=1) * len(v) ** -0.2
    at = np.linspace(v.min() - cut * w, v.max() + cut * w, points)
    return at, np.exp(-(((at[:, None] - v) / w) ** 2) / 2).sum(1) / (len(v) * w * math.sqrt(2 * math.pi))


@pytest.fixture
def samples():
    rng = np.random.default_rng(5)
    return {
        "normal": rng.normal(3, 2, 3000),
        "two": np.concatenate([rng.normal(-50, 1, 400), rng.normal(90, 5, 100)]),
        "tail": rng.pareto(2.5, 2000),
        "pair": np.array([1.0, 4.0]),
        None: rng.uniform(0, 1, 50),
    }


def held(out, key):
    rows = sorted((r.point, r.at, r.density) for r in out.collect() if r.g == key)
    return [np.array(c) for c in zip(*rows, strict=True)]


@pytest.mark.parametrize("most", [100_000, 1])
def test_equals_the_direct_sum(spark, samples, monkeypatch, most):
    monkeypatch.setattr(density, "MOST_GROUPS", most)
    rows = [(k, float(x), 0.0) for k, v in samples.items() for x in v]
    df = spark.createDataFrame(rows, "g string, v double, width double").repartition(7)
    out = density.densities(df, ["g"], "v").cache()
    for key, v in samples.items():
        point, at, found = held(out, key)
        want_at, want = direct(v)
        assert point.tolist() == list(range(200))
        np.testing.assert_allclose(at, want_at, rtol=1e-9, atol=1e-9)
        assert np.abs(found - want).max() <= 1e-3 * want.max()
        assert abs(np.sum(found) * (at[1] - at[0]) - 1) < 0.02


def test_given_bandwidth_points_and_two_groups(spark):
    rows = [("a", 1, float(x)) for x in (0, 1, 5)] + [("a", 2, 7.0)]
    out = density.densities(spark.createDataFrame(rows, "a string, b int, n double"), ["a", "b"], "n", points=31, cut=2, bandwidth=0.5).collect()
    for b, v in ((1, [0, 1, 5]), (2, [7])):
        found = [r.density for r in sorted((r for r in out if r.b == b), key=lambda r: r.point)]
        want = direct(v, 31, 2, 0.5)[1]
        assert np.abs(np.array(found) - want).max() <= 2e-3 * want.max()


def test_values_that_are_none_and_groups_without_deviation(spark):
    rows = [("a", x) for x in (None, math.nan, math.inf, -math.inf, 1.0, 2.0, 2.5)] + [("b", 3.0), ("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    out = density.densities(df, ["g"], "v", points=50)
    assert {r.g for r in out.collect()} == {"a"}
    np.testing.assert_allclose(held(out, "a")[2], direct([1, 2, 2.5], 50)[1], atol=1e-3)
    assert density.densities(df.limit(0), ["g"], "v").count() == 0
    with pytest.raises(ValueError):
        density.densities(df, ["g"], "v", points=1)


def test_rows_of_the_kernel_step_do_not_grow_with_the_table(spark):
    base = spark.range(20_000).selectExpr("id % 2 g", "cast(id % 1000 as double) v")
    values = base.selectExpr("g _density_g0", "v _density_value")
    for times in (1, 10):
        many = values.crossJoin(spark.range(times)).drop("id")
        stats = density._stats(many, ["_density_g0"], 200, 3.0, 30.0)
        assert density._cells(many, stats, ["_density_g0"]).count() <= 2 * (1000 / (30 / density.FINE) + 1)
