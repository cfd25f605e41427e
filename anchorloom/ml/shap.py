"""Path-dependent Shapley values of boosted trees, computed for a batch of rows at once.

A leaf's path tests each of its features by an interval; where a feature is unknown, rows pass with the share of training rows
that did. For a leaf of value v, feature i contributes v (o_i - z_i) times the mean, over orders of the others, of the product of o
of those before i and z of those after: o is 1 where the row passes the feature's interval, z the share that passes. These means are coefficients
of a polynomial in the features' o and z. Rows that pass the same intervals share the result, so it is computed once for
each pattern that occurs. Contributions and the base add up to the margin.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.ml.boosting import Boosted, Tree, matrix, plainly_named
from anchorloom.sources.settled import ship

#: For each leaf: its value and, by feature, the interval (above, to] that leads to it and the share of rows that pass it.
Leaf = tuple[float, dict[int, tuple[float, float, float]]]


def leaves(tree: Tree) -> list[Leaf]:
    out, todo = [], [(0, {})]
    while todo:
        node, held = todo.pop()
        f = tree.feature[node]
        if f < 0:
            out.append((tree.value[node], held))
            continue
        above, to, share = held.get(f, (-np.inf, np.inf, 1.0))
        t = tree.threshold[node]
        for child, span in ((tree.left[node], (above, min(to, t))), (tree.right[node], (max(above, t), to))):
            todo.append((child, held | {f: (*span, share * tree.rows[child] / tree.rows[node])}))
    return out


def base(model: Boosted) -> float:
    """The margin of a row of which nothing is known."""
    return model.start + sum(v * float(np.prod([z for *_, z in held.values()])) for t in model.trees for v, held in leaves(t))


def contributions(model: Boosted, x: np.ndarray, found: list[list[Leaf]] | None = None) -> np.ndarray:
    """A row for each of x, a number for each feature."""
    out = np.zeros((len(x), len(model.columns)))
    for tree in found or [leaves(t) for t in model.trees]:
        for value, held in tree:
            if not held or not len(x):
                continue
            features, z = list(held), np.array([s for *_, s in held.values()])
            # Null goes left, so it passes what has no lower bound.
            passed = np.stack([np.where(np.isnan(x[:, f]), a == -np.inf, (x[:, f] > a) & (x[:, f] <= b)) for f, (a, b, _) in held.items()], 1)
            patterns, back = np.unique(passed, axis=0, return_inverse=True)
            o, d = patterns.astype(float), len(features)
            weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) for s in range(d)])
            phi = np.empty((len(o), d))
            for i in range(d):
                poly = np.zeros((len(o), d))
                poly[:, 0] = 1
                for j in range(d):
                    if j != i:
                        raised = np.zeros_like(poly)
                        raised[:, 1:] = poly[:, :-1] * o[:, j : j + 1]
                        poly = poly * z[j] + raised
                phi[:, i] = value * (o[:, i] - z[i]) * (poly @ weight)
            out[:, features] += phi[back.reshape(-1)]
    return out


def tree_shap(df: DataFrame, model: Boosted) -> DataFrame:
    """df with shap_<feature> for each feature of the model and shap_base; their sum is the margin."""
    ship(df.sparkSession)
    ready, inputs, schema = plainly_named(df, model.columns)
    kept, made = len(df.columns), [f"shap{k}" for k in range(len(model.columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [leaves(t) for t in model.trees]
        for b in batches:
            phi = contributions(model, matrix(b, inputs), found)
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], *(pa.array(phi[:, k]) for k in range(phi.shape[1]))], [*b.schema.names[:kept], *made])

    out = ready.mapInArrow(run, ", ".join([schema, *(f"{c} double" for c in made)])).toDF(*df.columns, *[f"shap_{c}" for c in model.columns])
    return out.withColumn("shap_base", F.lit(base(model)))
