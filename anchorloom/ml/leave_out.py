"""Leave-one-cell-out logistic regressions, all of them fitted in the same scans.

The model of a cell learns from the rows of all other cells. With k cells these are k fits over nearly the same table. Here
each task reads its rows once an iteration and sums, for every model whose cell is not the row's, the loss, its gradient and
its second derivatives (one matrix product a model and batch). These sums, a few numbers for each model and pair of columns,
are added up by model and place in Spark; the driver takes a Newton step for each model that still moves and halves the step
of one whose loss rose. So the number of scans is that of the slowest model's steps, not the sum over models.

What is minimised is the sum of log losses over the model's rows plus |w|^2 / (2 C), w without the intercept: with C the
inverse of penalty and rows as elsewhere in this package. Columns are centred and scaled inside for the numbers' sake only; the penalty
stays that of the given columns, so results do not depend on it.

Rows whose label or cell is null, or with a null or non-finite column, are left out; a column without deviation gets no weight. A model
whose training rows are all of one label is the intercept LIMIT or -LIMIT alone, one without training rows is zero. The sums of at most
MOST_CELLS cells and MOST_COLUMNS columns, MOST_SUMS numbers in all, go to the driver; more fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL
from anchorloom.ml.training import cells_of
from anchorloom.operators import evaluation
from anchorloom.sources.settled import settled, ship

MOST_COLUMNS, MOST_SUMS, STEPS, TOLERANCE, LIMIT = 500, 10_000_000, 100, 1e-10, 30.0


@dataclass
class LeftOut:
    """Weights of the given columns and intercepts, a row for each cell left out; scans: how often the table was read."""

    cells: list[str]
    columns: list[str]
    weights: np.ndarray
    intercepts: np.ndarray
    scans: int


def sums(x: np.ndarray, label: np.ndarray, cell: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """For each model (a row of weights, the intercept last) the loss, gradient and upper second derivatives over the rows of
    all cells but the model's own. x ends with a column of ones; cell numbers the rows' cells as the models."""
    margin = x @ weights.T
    use = cell[:, None] != np.arange(len(weights))
    p = 1 / (1 + np.exp(-np.clip(margin, -700, 700)))
    loss = (np.where(use, np.logaddexp(0, margin) - label[:, None] * margin, 0)).sum(0)
    gradient = np.where(use, p - label[:, None], 0).T @ x
    upper = np.triu_indices(x.shape[1])
    curved = np.where(use, p * (1 - p), 0)
    second = np.array([((x * c[:, None]).T @ x)[upper] for c in curved.T]).reshape(len(weights), -1)
    return np.hstack([loss[:, None], gradient, second])


def _scan(rows: DataFrame, weights: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """sums() over the whole table of (cell number, label, values)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if not b.num_rows:
                continue
            raw = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            x = np.hstack([(raw - centre) / scale, np.ones((b.num_rows, 1))])
            made = sums(x, b.column(1).to_numpy().astype(float), b.column(0).to_numpy(), weights)
            total = made if total is None else total + made
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["place", "value"])

    d = weights.shape[1]
    found = rows.mapInArrow(run, "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(len(weights) * (1 + d + d * (d + 1) // 2))
    out[found.column("place").to_numpy()] = found.column("value").to_numpy()
    return out.reshape(len(weights), -1)


def _step(weights: np.ndarray, gradient: np.ndarray, second: np.ndarray, penalty: np.ndarray) -> np.ndarray:
    d = len(weights)
    h = np.zeros((d, d))
    h[np.triu_indices(d)] = second
    h = h + np.triu(h, 1).T + np.diag(penalty)
    # A floor below what tells apart two losses keeps the system solvable where all rows are certain.
    return np.linalg.solve(h + 1e-9 * np.eye(d), gradient + penalty * weights)


def fit(df: DataFrame, columns: list[str], c: float = 1.0) -> LeftOut:
    """A model for each cell of df (cell_type, label, columns). df is settled when this is called."""
    if not 0 < len(columns) <= MOST_COLUMNS:
        raise ValueError(f"from 1 to {MOST_COLUMNS} columns")
    spark = df.sparkSession
    ship(spark)
    values = F.array(*[F.col(f"`{n}`").cast("double") for n in columns])
    rows = df.select(F.col(CELL).alias("cell"), F.col("label").cast("double").alias("label"), values.alias("x")).where("cell is not null and label is not null and forall(x, v -> v is not null and not isnan(v) and abs(v) < double('infinity'))")
    rows = settled(rows)
    cells = cells_of(rows.select(F.col("cell").alias(CELL)))
    if len(cells) * (len(columns) + 2) ** 2 // 2 > MOST_SUMS:
        raise ValueError(f"more than {MOST_SUMS} sums of {len(cells)} models")
    places = {n: i for i, n in enumerate(cells)}
    if not cells:
        return LeftOut([], columns, np.zeros((0, len(columns))), np.zeros(0), 0)
    number = spark.createDataFrame(list(places.items()), f"cell_ {rows.schema['cell'].dataType.simpleString()}, number long")
    numbered = rows.join(F.broadcast(number), F.col("cell") == F.col("cell_")).select("number", "label", "x")
    one = rows.agg(*[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(len(columns)) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    centre, scale = (np.array([one[f"{k}{i}"] for i in range(len(columns))]) for k in "ms")
    flat = scale <= 1e-12 * np.maximum(np.abs(centre), 1)
    scale[flat] = np.inf
    d = len(columns) + 1
    penalty = np.append(1 / (c * scale**2), 0.0)
    weights, step, best = np.zeros((len(cells), d)), np.zeros((len(cells), d)), np.full(len(cells), np.inf)
    seen = np.zeros((len(cells), 2))
    for r in numbered.groupBy("number").agg(F.count_if(F.col("label") < 0.5).alias("none"), F.count_if(F.col("label") >= 0.5).alias("one")).collect():
        seen[r.number] = r.none, r.one
    others = seen.sum(0) - seen
    moving, scans = (others > 0).all(1), 0
    weights[~moving, -1] = LIMIT * np.sign(others[~moving, 1] - others[~moving, 0])
    while moving.any() and scans < STEPS:
        # Models at rest are still summed, so that places stay the same.
        made = _scan(numbered, weights, centre, scale)
        scans += 1
        for k in np.flatnonzero(moving):
            loss = made[k, 0] + (penalty * weights[k] ** 2).sum() / 2
            if loss > best[k] + 1e-9 * abs(best[k]):
                step[k] /= 2
                weights[k] += step[k]
                moving[k] = np.abs(step[k]).max() > TOLERANCE
                continue
            best[k] = loss
            step[k] = _step(weights[k], made[k, 1 : 1 + d], made[k, 1 + d :], penalty)
            moved = np.abs(step[k]).max()
            if moved <= TOLERANCE * max(1.0, np.abs(weights[k]).max()):
                moving[k] = False
                continue
            weights[k] -= step[k]
    raw = np.where(flat, 0.0, weights[:, :-1] / scale)
    return LeftOut(cells, columns, raw, weights[:, -1] - raw @ centre, scans)


def predict(df: DataFrame, model: LeftOut) -> DataFrame:
    """df with margin and prediction of each row by the model that did not see its cell; null where that model or a value is missing."""
    spark = df.sparkSession
    rows = [(cell, [*map(float, w), float(b)]) for cell, w, b in zip(model.cells, model.weights, model.intercepts, strict=True)]
    held = spark.createDataFrame(rows, f"_left_cell {df.schema[CELL].dataType.simpleString()}, _left_weights array<double>")
    margin = F.col("_left_weights")[len(model.columns)]
    for i, n in enumerate(model.columns):
        margin = margin + F.col("_left_weights")[i] * F.col(f"`{n}`").cast("double")
    out = df.join(F.broadcast(held), F.col(CELL) == F.col("_left_cell"), "left").withColumn("margin", margin)
    return out.withColumn("prediction", (F.col("margin") > 0).cast("int")).drop("_left_cell", "_left_weights")


def across(df: DataFrame, columns: list[str], c: float = 1.0) -> DataFrame:
    """Confusion counts and metrics on each cell of the model fitted on all others."""
    made = predict(df, fit(df, columns, c)).where("prediction is not null and label is not null").select(F.col(CELL).alias("grp"), "label", F.col("prediction").alias("pred"))
    made = settled(made)
    return evaluation.confusion(made).join(evaluation.binary_metrics(made), "grp")
