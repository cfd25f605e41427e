"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of each whole text come from its bytes' histogram and its words' hashes. The trees are fitted on the driver
on at most SAMPLE labelled documents (the first by a hash of doc_id), whose statistics are a few numbers each; they are
complete trees in flat arrays, which workers walk for all rows of a batch at once with numpy.

Defined cases: null text is an empty text; an empty text has statistics (zeros) and so a score; a doc_id labelled twice
counts as good if any label says so; labels without a document or a quality are not used; without labels every score is
0.5, with labels of one kind the smoothed share of good ones; rows that share a doc_id are scored each; an empty table
gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common

SAMPLE, TREES, DEPTH, BINS, RATE, CUT = 40_000, 60, 4, 64, 0.15, 0.7
NAMES = (
    "log_words log_bytes bytes_a_word upper digits symbols shouts bars commas stops other_marks spaces lines_a_word"
    " high_bytes unique_words repeated_threes repeated_next top_word duplicate_lines line_spread byte_entropy short_words"
).split()


def statistics(text: str | None, hashes: common.WordHashes) -> list[float]:
    data = (text or "").encode("utf-8", "surrogatepass")
    ws = data.split()
    n, size = max(1, len(ws)), max(1, len(data))
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda s: float(h[list(s)].sum())
    ids = hashes.of(ws)
    many = np.unique(ids, return_counts=True)[1] if len(ids) else np.zeros(1)
    threes = np.unique(common.grams(ids, 3), return_counts=True)[1]
    lines = [x for x in data.split(b"\n") if x.strip()]
    lengths = np.array([len(x) for x in lines] or [0], float)
    share = h[h > 0] / size
    letters = of(range(65, 91)) + of(range(97, 123))
    return [
        np.log1p(len(ws)), np.log1p(len(data)), len(data) / n, of(range(65, 91)) / max(1.0, letters), of(range(48, 58)) / size,
        of(b"#*$%&<>") / n, of(b"!") / n, of(b"|") / n, of(b",") / n, of(b".") / n, of(b"?:;\"'()[]{}_-=+@~^`/\\") / n,
        of(b" \t\r\n") / size, len(lines) / n, float(h[128:].sum()) / size, len(many) / n,
        float(threes[threes > 1].sum()) / n, float((ids[1:] == ids[:-1]).sum()) / n, float(many.max()) / n,
        1 - len(set(lines)) / max(1, len(lines)), float(lengths.std() / (lengths.mean() + 1)), float(-(share * np.log2(share)).sum()),
        sum(len(w) < 3 for w in ws) / n,
    ]


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): statistics of every text."""
    common.ship(docs.sparkSession)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = common.WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([statistics(t, hashes) for t in b.column(1).to_pylist()], pa.list_(pa.float64()))], ["doc_id", "x"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, x array<double>")


@dataclass
class Trees:
    """Complete binary trees: node i has children 2 i + 1 (at most the threshold) and 2 i + 2; leaves come last."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def scores(self, x: np.ndarray) -> np.ndarray:
        total, rows, inner = np.full(len(x), self.start), np.arange(len(x)), self.feature.shape[1] if len(self.feature) else 0
        for f, t, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while node[0] < inner if len(node) else False:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += leaf[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = 1.0) -> Trees:
    good = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(good / (1 - good)))
    empty = Trees(start, np.empty((0, 2**depth - 1), np.int64), np.empty((0, 2**depth - 1)), np.empty((0, 2**depth)))
    if len(y) < 2 or y.min() == y.max():
        return empty
    n, m = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)  # bin <= b: x <= edges[b]
    score, features, thresholds, leaves = np.full(n, start), [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        f, t, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.inf), np.zeros(n, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            own = node - first
            best = np.full(width, 1e-6)
            whole_g, whole_h = np.bincount(own, g, width), np.bincount(own, h, width)
            for j in range(m):
                cell = own * bins + binned[:, j]
                left_g, left_h = (np.bincount(cell, v, width * bins).reshape(width, bins).cumsum(1) for v in (g, h))
                right_g, right_h = whole_g[:, None] - left_g, whole_h[:, None] - left_h
                gain = left_g**2 / (left_h + l2) + right_g**2 / (right_h + l2) - (whole_g**2 / (whole_h + l2))[:, None]
                gain[:, len(edges[j]) :] = 0
                gain[(left_h < 1) | (right_h < 1)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best
                best[better] = gain[np.arange(width), at][better]
                f[first : first + width][better] = j
                t[first : first + width][better] = edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), f[node]] > t[node])
        own = node - (2**depth - 1)
        leaf = rate * np.bincount(own, g, 2**depth) / (np.bincount(own, h, 2**depth) + l2)
        score += leaf[own]
        features.append(f)
        thresholds.append(t)
        leaves.append(leaf)
    return Trees(start, np.array(features), np.array(thresholds), np.array(leaves))


def held_out(doc_id: str = "doc_id", modulus: int = 4, rest: int = 2) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == rest, F.lit(False))


def learn(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from written featured() rows and labels (doc_id, quality) of which held-out ones are not used."""
    usable = labels.where("doc_id is not null and quality is not null").where(~held_out())
    marked = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int")).alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # Rows that share a doc_id are more than the labels: the bound holds for rows too.
    rows = stats.join(marked, "doc_id").select("doc_id", "x", "y").orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample).collect()
    rows.sort(key=lambda r: (r.doc_id, r.x))
    return fit(np.array([r.x for r in rows]).reshape(-1, len(NAMES)), np.array([r.y for r in rows], float))


def score(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of docs."""
    stats = common.written(featured(docs))
    trees = learn(stats, labels, sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(trees.scores(x))], ["doc_id", "score"])

    made = stats.mapInArrow(run, "doc_id long, score double")
    return made.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
