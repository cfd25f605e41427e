"""Gradient-boosted trees grown leaf by leaf on binned features, for a label of 0 or 1.

1. Features are binned once by quantiles (null and NaN: the lowest bin) and settled as small numbers with label and score.
2. For a tree, tasks sum gradients, hessians and rows by leaf, feature and bin over their rows; only these sums are shuffled
   and come to the driver: numbers for leaves x features x bins, whatever the rows. Of two siblings the smaller one is summed,
   the other one is the parent less its sibling.
3. The leaf of greatest gain is split next, until `leaves` are reached. One pass over the rows sums for all leaves that may
   come next, so a tree takes about as many passes as it is deep, not as it has leaves; which splits are made is as if
   each had its own pass.
4. Scores are settled after each tree, so no plan grows with the number of trees.

Gradients are summed as integers of 2^-24, so sums do not depend on the order of tasks and reruns give the same trees.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.sources.settled import settled, ship

SCALE = 1 << 24
SUMS = "leaf int, feature int, bin int, g long, h long, n long"


@dataclass
class Tree:
    """Node k: rows whose feature is at most the threshold go left. Leaves have feature -1. rows: training rows of each node."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    rows: list[int] = field(default_factory=list)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf that each row ends in; null and NaN go left."""
        feature, threshold, left, right = np.array(self.feature), np.array(self.threshold), np.array(self.left), np.array(self.right)
        node = np.zeros(len(x), np.int64)
        while (feature[node] >= 0).any():
            inner = np.flatnonzero(feature[node] >= 0)
            at = node[inner]
            node[inner] = np.where(x[inner, feature[at]] > threshold[at], right[at], left[at])
        return node


@dataclass
class Boosted:
    columns: list[str]
    start: float
    trees: list[Tree]

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in self.trees:
            out += np.array(t.value)[t.leaf_of(x)]
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def loads(text: str) -> Boosted:
        made = json.loads(text)
        return Boosted(made["columns"], made["start"], [Tree(**t) for t in made["trees"]])


def matrix(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Columns of a batch as rows of doubles, nulls as NaN."""
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(float) for c in columns], 1) if columns else np.empty((batch.num_rows, 0))


def edges_of(df: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper edges of each feature's bins but the last: at most bins - 1 distinct quantiles."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    found = df.agg(*[F.percentile_approx(F.when(~F.isnan(F.col(f"`{c}`").cast("double")), F.col(f"`{c}`").cast("double")), at, F.lit(100 * bins)).alias(f"c{k}") for k, c in enumerate(columns)]).first()
    return [np.unique(np.array(v or [], float)) for v in found]


def _binned(df: DataFrame, columns: list[str], label: str, edges: list[np.ndarray]) -> DataFrame:
    names = [f"c{k}" for k in range(len(columns))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b, names)
            codes = np.stack([np.where(np.isnan(x[:, k]), 0, np.searchsorted(e, x[:, k], "left")) for k, e in enumerate(edges)], 1).astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in codes], pa.binary()), b.column(len(names)), pa.array(np.zeros(b.num_rows))], ["codes", "label", "score"])

    slim = df.select(*[F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(columns, names, strict=True)], F.col(label).cast("int").alias("label")).where("label is not null")
    return slim.mapInArrow(run, "codes binary, label int, score double")


def _codes(b: pa.RecordBatch, m: int) -> np.ndarray:
    return np.frombuffer(b"".join(b.column(0).to_pylist()), "<i2").reshape(-1, m)


def _walk(codes: np.ndarray, feature: list[int], cut: list[int], left: list[int], right: list[int]) -> np.ndarray:
    node, f = np.zeros(len(codes), np.int64), np.array(feature)
    c, low, high = np.array(cut), np.array(left), np.array(right)
    while (inner := np.flatnonzero(f[node] >= 0)).size:
        at = node[inner]
        node[inner] = np.where(codes[inner, f[at]] > c[at], high[at], low[at])
    return node


class _Growing:
    """A tree whose nodes may be more than those kept: splits tried ahead are undone when others come first."""

    def __init__(self, m: int, bins: int, l2: float, least: int):
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.sums: dict[int, np.ndarray] = {}  # node: (3, features, bins)
        self.split: dict[int, tuple[float, int, int]] = {}
        self.m, self.bins, self.l2, self.least = m, bins, l2, least

    def take(self, node: int, sums: np.ndarray) -> None:
        """A node's sums, and its best split (gain, feature, bin): ties go to the first feature, then the lowest bin."""
        self.sums[node] = sums
        g, h, n = (sums[k].cumsum(1) for k in range(3))
        whole = sums[:, 0].sum(1)
        rest = [whole[k] - x for k, x in enumerate((g, h, n))]
        score = lambda a, b: (a / SCALE) ** 2 / (np.maximum(b / SCALE, 0) + self.l2)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = score(g, h) + score(rest[0], rest[1]) - score(whole[0], whole[1])
        gain[(n < self.least) | (rest[2] < self.least) | ~np.isfinite(gain)] = -np.inf
        at = int(gain.argmax())
        self.split[node] = (float(gain.flat[at]), at // self.bins, at % self.bins)

    def divide(self, node: int) -> tuple[int, int]:
        _, f, c = self.split[node]
        a, b = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = f, c, a, b
        for _ in (a, b):
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.right.append(0)
        return a, b

    def smaller(self, node: int) -> int:
        """Which child has fewer rows, by the node's own sums."""
        _, f, c = self.split[node]
        n = self.sums[node][2, f]
        return self.left[node] if 2 * n[: c + 1].sum() <= n.sum() else self.right[node]

    def chosen(self, leaves: int, least_gain: float) -> tuple[list[int], list[int]]:
        """Nodes split in order of gain until `leaves` are reached or sums are missing, and open nodes that may be split next."""
        order, open_ = [], [0]
        while len(order) + 1 < leaves:
            good = [k for k in open_ if self.split[k][0] > least_gain]
            if not good:
                return order, []
            best = max(good, key=lambda k: (self.split[k][0], -k))
            if self.feature[best] < 0 or self.left[best] not in self.split:
                rank = sorted((k for k in good if self.feature[k] < 0), key=lambda k: (-self.split[k][0], k))
                return order, rank[: leaves - len(order) - 1]
            open_ = [k for k in open_ if k != best] + [self.left[best], self.right[best]]
            order.append(best)
        return order, []


def _sums(data: DataFrame, grown: _Growing, wanted: list[int]) -> dict[int, np.ndarray]:
    """Sums of the wanted nodes' rows."""
    shape, m, bins = (grown.feature, grown.cut, grown.left, grown.right), grown.m, grown.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(shape[0]), -1)
        place[wanted] = np.arange(len(wanted))
        total = np.zeros((3, len(wanted) * m * bins), np.int64)
        for b in batches:
            codes = _codes(b, m)
            own = place[_walk(codes, *shape)]
            kept = own >= 0
            p = 1 / (1 + np.exp(-b.column(2).to_numpy()[kept]))
            g = np.rint((b.column(1).to_numpy()[kept] - p) * SCALE).astype(np.int64)
            h = np.rint(p * (1 - p) * SCALE).astype(np.int64)
            for k in range(m):
                cell = (own[kept] * m + k) * bins + codes[kept, k]
                for i, v in enumerate((g, h, None)):
                    total[i] += np.bincount(cell, v, total.shape[1]).astype(np.int64)  # exact: a batch's sums stay below 2^53
        at = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in (at // (m * bins), at // bins % m, at % bins)), *(pa.array(total[i][at]) for i in range(3))], ["leaf", "feature", "bin", "g", "h", "n"])

    found = data.mapInArrow(run, SUMS).groupBy("leaf", "feature", "bin").agg(*[F.sum(c).alias(c) for c in "ghn"]).toArrow()
    out = np.zeros((len(wanted), 3, m, bins), np.int64)
    at = [found.column(c).to_numpy() for c in ("leaf", "feature", "bin")]
    for i, c in enumerate("ghn"):
        out[at[0], i, at[1], at[2]] = found.column(c).to_numpy()
    return dict(zip(wanted, out, strict=True))


def _grow(data: DataFrame, m: int, bins: int, leaves: int, l2: float, least: int, least_gain: float) -> tuple[_Growing, list[int]]:
    grown = _Growing(m, bins, l2, least)
    grown.take(0, _sums(data, grown, [0])[0])
    while True:
        order, ahead = grown.chosen(leaves, least_gain)
        if not ahead:
            return grown, order
        for node in ahead:
            grown.divide(node)
        small = {grown.smaller(node): node for node in ahead}
        for child, sums in _sums(data, grown, list(small)).items():
            node = small[child]
            other = grown.left[node] + grown.right[node] - child
            grown.take(child, sums)
            grown.take(other, grown.sums[node] - sums)


def fit(df: DataFrame, columns: list[str], label: str = "label", trees: int = 100, leaves: int = 31, rate: float = 0.1, bins: int = 255, least: int = 20, l2: float = 0.0, least_gain: float = 1e-9) -> Boosted:
    """A model of the rows of df with a label. Jobs run when this is called, a few for each tree."""
    if not 2 <= bins <= 1 << 15 or least < 1:
        raise ValueError("bins must be from 2 to 32768, and a leaf must hold a row")
    ship(df.sparkSession)
    edges = edges_of(df, columns, bins)
    data, m = settled(_binned(df, columns, label, edges)), len(columns)
    n, good = data.agg(F.count("*"), F.sum("label")).first()
    share = ((good or 0) + 1e-9) / (n + 2e-9)
    out = Boosted(list(columns), float(np.log(share / (1 - share))), [])
    if not m or not n or good in (0, n):
        return out
    data = settled(data.withColumn("score", F.lit(out.start)))
    for _ in range(trees):
        grown, order = _grow(data, m, bins, leaves, l2, least, least_gain)
        if not order:
            break
        tree, names = Tree(), {}

        def put(node: int, grown=grown, kept=frozenset(order), tree=tree) -> int:
            at, g = len(tree.feature), grown.sums[node][:, 0].sum(1)
            value = rate * (g[0] / SCALE) / (g[1] / SCALE + l2) if g[1] else 0.0
            for field_, v in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value, tree.rows), (-1, 0.0, 0, 0, float(value), int(g[2])), strict=True):
                field_.append(v)
            if node in kept:
                f, c = grown.feature[node], grown.cut[node]
                tree.feature[at], tree.threshold[at] = f, float(edges[f][c])
                tree.left[at] = put(grown.left[node])
                tree.right[at] = put(grown.right[node])
            return at

        put(0)
        out.trees.append(tree)
        # In bins again: a threshold is the upper edge of its bin.
        cuts = [int(np.searchsorted(edges[f], t)) if f >= 0 else 0 for f, t in zip(tree.feature, tree.threshold, strict=True)]

        def rescored(batches: Iterator[pa.RecordBatch], tree=tree, cuts=cuts) -> Iterator[pa.RecordBatch]:
            for b in batches:
                leaf = _walk(_codes(b, m), tree.feature, cuts, tree.left, tree.right)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(b.column(2).to_numpy() + np.array(tree.value)[leaf])], ["codes", "label", "score"])

        data = settled(data.mapInArrow(rescored, "codes binary, label int, score double"))
    return out


def plainly_named(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str], str]:
    """df's columns as c0, c1..., then those of a model as doubles x0, x1...; the latter's names, and the schema of the former.

    Python functions over batches know no names with dots."""
    inputs = [f"x{k}" for k in range(len(columns))]
    own = [F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(df.columns)]
    ready = df.select(*own, *[F.col(f"`{c}`").cast("double").alias(x) for c, x in zip(columns, inputs, strict=True)])
    return ready, inputs, ", ".join(f"c{k} {t}" for k, (_, t) in enumerate(df.dtypes))


def predict(df: DataFrame, model: Boosted) -> DataFrame:
    """df with probability and prediction (0 or 1)."""
    ship(df.sparkSession)
    ready, inputs, schema = plainly_named(df, model.columns)
    kept = len(df.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:kept], pa.array(model.margins(matrix(b, inputs)))], [*b.schema.names[:kept], "margin"])

    out = ready.mapInArrow(run, f"{schema}, margin double").toDF(*df.columns, "_margin")
    return out.withColumn("probability", 1 / (1 + F.exp(-F.col("_margin")))).withColumn("prediction", (F.col("_margin") > 0).cast("int")).drop("_margin")
