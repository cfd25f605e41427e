"""Connected components as DataFrame rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.llm import common

#: Edges that a task holds at once.
HOLD = 1_000_000


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of all nodes of edges (a, b) but those least ones."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.split(at, 2)
    label = np.arange(len(nodes))
    while True:
        x, y = label[x], label[y]
        open_ = x != y
        x, y = x[open_], y[open_]
        if not len(x):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    below = label != np.arange(len(nodes))
    return nodes[below], nodes[label[below]]


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) that connect what edges connects, a star for each component of HOLD edges of a task: before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= HOLD:
                held = [spanning(*map(np.concatenate, zip(*held, strict=True)))]
                n = len(held[0][0])
                if 2 * n >= HOLD:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in held[0]], ["a", "b"])
                    held, n = [], 0
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in spanning(*map(np.concatenate, zip(*held, strict=True)))], ["a", "b"])

    return edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (a, b) with a <> b: the smallest node reachable.

    Tasks first reduce what they hold to stars. While more than HOLD edges are left, rounds of contraction follow: each
    node joins its neighbour (or itself) of least priority, equal edges become one and loops go, so rounds shrink; a
    round's map is written, so that lost executors lose nothing. Priorities are hashes, which shrink any path. Minima
    combine before the shuffle, and Spark splits skewed joins, so hubs are no hot task. The last HOLD edges at most are
    one task's.
    """
    common.ship(edges.sparkSession)
    left, levels = common.written(forest(edges)), []
    while left.count() > HOLD:
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = lambda c, salt=len(levels): F.xxhash64(F.col(c), F.lit(salt))
        near = both.groupBy("a").agg(F.min_by("b", first("b")).alias("b"))
        level = common.written(near.select(F.col("a").alias("node"), F.when(first("a") <= first("b"), F.col("a")).otherwise(F.col("b")).alias("up")))
        ends = left.join(level.withColumnRenamed("up", "x"), F.col("a") == F.col("node")).select("b", "x")
        ends = ends.join(level.withColumnRenamed("up", "y"), F.col("b") == F.col("node")).select("x", "y").where("x <> y")
        new = common.written(forest(ends.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
        common.forget(left)
        left, levels = new, [*levels, level]

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if held:
            node, root = spanning(*map(np.concatenate, zip(*held, strict=True)))
            roots = np.unique(root)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([node, roots])), pa.array(np.concatenate([root, roots]))], ["node", "component"])

    whole = common.written(left.coalesce(1).mapInArrow(last, "node long, component long"))
    common.forget(left)
    if not levels:
        return whole
    whole = whole.withColumnRenamed("component", "up")
    for level in reversed(levels):
        later = whole.select(F.col("node").alias("at"), F.col("up").alias("root"))
        whole = level.join(later, level.up == later.at, "left").select("node", F.coalesce("root", "up").alias("up"))
    whole = common.written(whole)
    common.forget(*levels)
    least = whole.groupBy("up").agg(F.min("node").alias("component")).withColumnRenamed("up", "root")
    return whole.join(least, whole.up == least.root).select("node", "component")
