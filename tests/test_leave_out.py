import math

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler

from anchorloom.ml import leave_out


def table(n=1200, cells=4, seed=3):
    rng = np.random.default_rng(seed)
    x = np.c_[rng.normal(0, 1, n), rng.normal(5000, 800, n), rng.integers(0, 3, n)]
    cell = rng.integers(0, cells, n)
    margin = 0.8 * x[:, 0] + (x[:, 1] - 5000) / 900 - 0.4 * x[:, 2] + 0.3 * cell
    label = rng.random(n) < 1 / (1 + np.exp(-margin))
    return [(f"c{c}", int(y), *map(float, r)) for c, y, r in zip(cell, label, x, strict=True)]


COLUMNS, SCHEMA = ["a", "b.b", "c"], "cell_type string, label int, a double, `b.b` double, c double"


def test_equals_separate_fits(spark):
    df = spark.createDataFrame(table(), SCHEMA).repartition(5)
    model = leave_out.fit(df, COLUMNS, c=2.0)
    assert model.cells == ["c0", "c1", "c2", "c3"] and model.scans < 15
    plain = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df.withColumnRenamed("b.b", "b"))
    for cell, w, b in zip(model.cells, model.weights, model.intercepts, strict=True):
        rest = plain.where(f"cell_type <> '{cell}'")
        one = LogisticRegression(standardization=False, regParam=1 / (2.0 * rest.count()), tol=1e-14, maxIter=1000).fit(rest)
        x = np.array([r.features.toArray() for r in rest.collect()])
        np.testing.assert_allclose(w[[0, 2]], one.coefficients.toArray()[[0, 2]], atol=1e-4)
        # The gradient of what is minimised vanishes, which the other solver reaches less closely on columns of so unlike scale.
        y = np.array([r.label for r in rest.collect()])
        off = 1 / (1 + np.exp(-(x @ w + b))) - y
        assert np.abs((off @ x + w / 2.0) / (1 + np.abs(x).sum(0))).max() < 1e-8 and abs(off.sum()) < 1e-6


def test_other_partitions_and_predictions(spark):
    rows = table(400, 3)
    one, many = (leave_out.fit(spark.createDataFrame(rows, SCHEMA).repartition(k), COLUMNS) for k in (1, 6))
    np.testing.assert_allclose(one.weights, many.weights, atol=1e-8)
    made = leave_out.predict(spark.createDataFrame(rows, SCHEMA), one).collect()
    for r in made:
        k = one.cells.index(r.cell_type)
        want = one.weights[k] @ [r.a, r["b.b"], r.c] + one.intercepts[k]
        assert math.isclose(r.margin, want, abs_tol=1e-9) and r.prediction == int(want > 0)
    metrics = leave_out.across(spark.createDataFrame(rows, SCHEMA), COLUMNS).collect()
    assert sum(r.tp + r.fp + r.fn + r.tn for r in metrics) == len(rows) and {r.grp for r in metrics} == set(one.cells)


def test_defined_cases(spark):
    rows = table(300, 2)
    odd = [("c0", None, 1.0, 1.0, 1.0), (None, 1, 1.0, 1.0, 1.0), ("c0", 1, None, 1.0, 1.0), ("c1", 1, math.nan, 1.0, 1.0), ("c1", 0, math.inf, 1.0, 1.0)]
    plain, held = (leave_out.fit(spark.createDataFrame(r, SCHEMA), COLUMNS) for r in (rows, rows + odd))
    np.testing.assert_allclose(plain.weights, held.weights, atol=1e-9)
    assert leave_out.fit(spark.createDataFrame([], SCHEMA), COLUMNS).cells == []
    flat = leave_out.fit(spark.createDataFrame([(c, y, a, 7.0, x) for c, y, a, _, x in rows], SCHEMA), COLUMNS)
    assert not flat.weights[:, 1].any() and np.isfinite(flat.weights).all()
    alone = leave_out.fit(spark.createDataFrame([("one", 1, 1.0, 2.0, 3.0), ("one", 0, 2.0, 1.0, 0.0)], SCHEMA), COLUMNS)
    assert not alone.weights.any() and not alone.intercepts.any()
    same = leave_out.fit(spark.createDataFrame([(f"c{i % 2}", 1, float(i), float(i % 5), 0.0) for i in range(40)], SCHEMA), COLUMNS)
    assert not same.weights.any() and same.intercepts.tolist() == [leave_out.LIMIT] * 2
    # Nearly parted by a column of wide values: the intercept of the centred columns is far from 0.
    wide = [(f"c{i % 2}", int(i > 150), float(i * i), 0.0, 0.0) for i in range(300)] + [("c0", 1, 21_000.0, 0.0, 0.0), ("c1", 1, 21_000.0, 0.0, 0.0)]
    model = leave_out.fit(spark.createDataFrame(wide, SCHEMA), COLUMNS, c=100.0)
    for cell, w, b in zip(model.cells, model.weights, model.intercepts, strict=True):
        x, y = (np.array([r[k] for r in wide if r[0] != cell], float) for k in (2, 1))
        off = 1 / (1 + np.exp(-(x * w[0] + b))) - y
        assert abs(off.sum()) < 1e-6 and abs(off @ x + w[0] / 100) < 1e-6 * np.abs(x).sum()
    with pytest.raises(ValueError):
        leave_out.fit(spark.createDataFrame(rows, SCHEMA), [])
