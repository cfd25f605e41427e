from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorloom.ml import boosting, shap, training

NAMES = [f"f.{k}" for k in range(6)]


def table(n=1500, seed=5):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(n, 6)), 2)
    x[:, 3] = r.integers(0, 4, n)
    x[::17, 1] = np.nan
    z = x[:, 0] + np.where(x[:, 3] == 2, 2, 0) * np.nan_to_num(x[:, 1]) - 0.5 * x[:, 4] * (x[:, 5] > 0)
    return x, (z + r.normal(scale=0.5, size=n) > 0).astype(int)


@pytest.fixture(scope="module")
def data(spark):
    x, y = table()
    rows = [(k, "A", int(b), *[None if np.isnan(v) else float(v) for v in a]) for k, (a, b) in enumerate(zip(x, y, strict=True))]
    made = spark.createDataFrame(rows, "id int, cell_type string, label int, " + ", ".join(f"`{c}` double" for c in NAMES)).repartition(5)
    return made.where("id < 1000").cache(), made.where("id >= 1000").cache()


@pytest.fixture(scope="module")
def model(data):
    return boosting.fit(data[0], NAMES, trees=12, leaves=9, bins=16, rate=0.3)


def auc(rows):
    good, bad = [r.p for r in rows if r.label == 1], [r.p for r in rows if r.label == 0]
    return np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])


def plain(x, y, edges, trees, leaves, rate, least=20):
    """The same growth, row by row: every split is searched over all features and cuts of the leaf's own rows."""
    share = y.mean()
    margin = np.full(len(y), np.log(share / (1 - share)))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((y - p) * (1 << 24)), np.rint(p * (1 - p) * (1 << 24))
        codes = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k])) for k, e in enumerate(edges)], 1)
        score = lambda m: (g[m].sum() / (1 << 24)) ** 2 / (h[m].sum() / (1 << 24))

        def search(m):
            best = (-np.inf, None)
            for f in range(x.shape[1]):
                for c in range(len(edges[f])):
                    a, b = m & (codes[:, f] <= c), m & (codes[:, f] > c)
                    if min(a.sum(), b.sum()) >= least and (gain := score(a) + score(b) - score(m)) > best[0] + 1e-12:
                        best = (gain, (a, b))
            return best

        parts = [np.ones(len(y), bool)]
        known = [search(parts[0])]
        while len(parts) < leaves and max(k[0] for k in known) > 1e-9:
            at = int(np.argmax([k[0] for k in known]))
            a, b = known[at][1]
            parts[at : at + 1], known[at : at + 1] = [a, b], [search(a), search(b)]
        for m in parts:
            margin[m] += rate * (g[m].sum() / h[m].sum())
    return margin


def test_same_trees_as_row_by_row_growth(data):
    x, y = table()
    x, y = x[:1000], y[:1000]
    got = boosting.fit(data[0], NAMES, trees=3, leaves=6, bins=8, rate=0.3)
    want = plain(x, y, boosting.edges_of(data[0], NAMES, 8), 3, 6, 0.3)
    assert np.allclose(got.margins(x), want, atol=1e-9)
    assert all(sum(f < 0 for f in t.feature) == 6 for t in got.trees)
    assert all(n == t.rows[a] + t.rows[b] for t in got.trees for f, n, a, b in zip(t.feature, t.rows, t.left, t.right, strict=True) if f >= 0)


def test_reruns_agree_whatever_the_partitions(data):
    a = boosting.fit(data[0], NAMES, trees=3, leaves=7, bins=16)
    b = boosting.fit(data[0].repartition(3, "id"), NAMES, trees=3, leaves=7, bins=16)
    assert a.dumps() == b.dumps() and boosting.Boosted.loads(a.dumps()) == a


def test_scores_at_least_as_well_as_level_wise_trees(data, model):
    from pyspark.ml.functions import vector_to_array

    own = auc(boosting.predict(data[1], model).select("label", F.col("probability").alias("p")).collect())
    filled = [d.fillna(-9.0) for d in data]
    other = training.fit(filled[0], "gradient_boosting", NAMES, {"n_estimators": 12, "learning_rate": 0.3, "max_depth": 3})
    theirs = auc(training.predict(filled[1], other, NAMES).select("label", vector_to_array("probability")[1].alias("p")).collect())
    assert own >= theirs - 0.005 and own > 0.85, (own, theirs)


def test_one_label_and_empty(spark, data):
    one = boosting.fit(data[0].where("label = 1"), NAMES, trees=2)
    assert one.trees == [] and boosting.predict(data[1], one).where("prediction = 0").count() == 0
    none = boosting.fit(data[0].limit(0), NAMES, trees=2)
    assert none.trees == [] and boosting.predict(data[1].limit(0), none).count() == 0
    with pytest.raises(ValueError, match="bins"):
        boosting.fit(data[0], NAMES, bins=1)


def expectation(tree, x, known, node=0):
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        return expectation(tree, x, known, b if x[f] > tree.threshold[node] else a)
    return (tree.rows[a] * expectation(tree, x, known, a) + tree.rows[b] * expectation(tree, x, known, b)) / tree.rows[node]


def test_contributions_are_shapley_values(model):
    x = table()[0][:40]
    got = shap.contributions(model, x)
    for row, phi in zip(x, got, strict=True):
        v = {s: sum(expectation(t, row, s) for t in model.trees) for n in range(7) for s in map(frozenset, combinations(range(6), n))}
        for i in range(6):
            want = sum(factorial(len(s)) * factorial(5 - len(s)) / 720 * (v[s | {i}] - v[s]) for s in v if i not in s)
            assert abs(phi[i] - want) < 1e-9


def test_contributions_and_base_add_up(data, model):
    made = shap.tree_shap(data[1], model).collect()
    x = np.array([[np.nan if r[c] is None else r[c] for c in NAMES] for r in made])
    total = [r.shap_base + sum(r[f"shap_{c}"] for c in NAMES) for r in made]
    assert len(made) == 500 and np.allclose(total, model.margins(x), atol=1e-9)


def test_folds_are_averaged(data):
    """The score is the mean of the folds' own areas, not the area of all folds' scores together."""
    filled = data[0].toDF(*[c.replace(".", "_") for c in data[0].columns]).fillna(0.0)
    want = np.mean([auc(f.collect()) for f in training._by_fold(filled, "decision_tree", ["id"], 3, None)])
    assert abs(training.cross_score(filled, "decision_tree", ["id"], 3) - want) < 1e-6


def test_hold_out_takes_a_metric_of_hard_predictions(data):
    filled = data[0].toDF(*[c.replace(".", "_") for c in data[0].columns]).fillna(0.0)
    found = {m: training.hold_out_score(filled, "decision_tree", ["id"], metric=m) for m in ("roc_auc", "f1", "accuracy")}
    assert len(set(found.values())) == 3 and all(0.5 < v < 1 for v in found.values())
