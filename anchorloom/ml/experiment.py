"""Whole experiments in one call: settings searched, models trained, judged and weighed, the run timed and logged.

within_cells trains a model on each cell's own train rows and judges it on the cell's test rows; across_cells trains on all other
cells' rows and judges on the cell's; by_folds judges every row by the model that did not see its fold, then trains one model on
all rows. Splits are made once for all cells, in one pass; models of several cells are fitted at a time.

Defined cases: rows with a null label, cell or feature are neither learnt from nor judged; a cell that leaves no rows to learn
from fails by name; repeated rows count each; an empty table fails; settings without a counterpart change nothing.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL
from anchorloom.ml import training
from anchorloom.ml.search import Search, Space
from anchorloom.operators import evaluation
from anchorloom.operators.sampling import folds, train_test
from anchorloom.sources import writers
from anchorloom.sources.settled import settled

TEST, VALIDATION, PARALLEL = 0.2, 0.3, 4
ALL = "all"


@dataclass(frozen=True)
class Tuning:
    """How settings are searched: the metric is that of hard predictions on rows kept from training (by folds: the area under the curve)."""

    trials: int = 20
    metric: str = "roc_auc"
    maximise: bool = True
    space: Space | None = None
    seconds: float | None = None


@dataclass(frozen=True)
class Outcome:
    """predictions (grp, label, pred, p) of the rows judged, and what follows from them; grp is the cell, or "all" by folds."""

    predictions: DataFrame
    models: dict[str, object]
    weights: list[tuple[str, str, float]]
    settings: dict[str, dict]
    seconds: dict[str, float] = field(default_factory=dict)

    @property
    def metrics(self) -> DataFrame:
        return evaluation.binary_metrics(self.predictions)

    @property
    def confusion(self) -> DataFrame:
        return evaluation.confusion(self.predictions)

    @property
    def curve(self) -> DataFrame:
        """(grp, score, tpr, fpr): scores are probabilities rounded to three digits, so a group has at most 1,001 points."""
        return evaluation.roc_points(self.predictions.withColumn("p", F.round("p", 3)), score="p")

    @property
    def importances(self) -> DataFrame:
        """(grp, feature, importance) of each group's model, the largest 20."""
        return self.predictions.sparkSession.createDataFrame(self.weights, "grp string, feature string, importance double")


def _at_a_time(spark: SparkSession, work: Callable, items: list, parallel: int) -> dict:
    with ThreadPool(max(1, min(parallel, len(items)))) as pool:
        return dict(zip(items, pool.map(inheritable_thread_target(spark)(work), items), strict=True))


def _judged(df: DataFrame, model, columns: list[str], grp: str) -> DataFrame:
    made = training.predict(df, model, columns)
    return made.select(F.lit(grp).alias("grp"), F.col("label").cast("int").alias("label"), F.col("prediction").alias("pred"), vector_to_array("probability")[1].alias("p"))


def _ready(df: DataFrame, key: list[str]) -> tuple[DataFrame, list[str]]:
    columns = training.inputs(df, key)
    if not columns:
        raise ValueError("no numeric columns to learn from")
    ready = df.select(*[c for c in key if c not in (CELL, "label")], CELL, "label", *[f"`{c}`" for c in columns if c not in key]).dropna("any", subset=[CELL, "label", *[c for c in columns if "." not in c]])
    return settled(ready), columns  # splits read it several times: df, with all that its columns are made of, is read once


def _best(data: DataFrame, kind: str, columns: list[str], tuning: Tuning) -> dict:
    """The setting with the best score on rows of part "check" after training on those of part "fit"; {} if none beats the defaults."""
    learn, check = data.where("part = 'fit'"), data.where("part = 'check'")
    search, began = Search(tuning.space or training.SPACES[kind], training.SEED, tuning.maximise), time.monotonic()

    def score(setting: dict) -> float:
        found = evaluation.binary_metrics(_judged(check, training.fit(learn, kind, columns, setting), columns, ALL)).select(tuning.metric).first()
        return found[0] if found else 0.0

    best, most = {}, score({})
    for _ in range(tuning.trials):
        if tuning.seconds is not None and time.monotonic() - began > tuning.seconds:
            break
        tried = search.ask()
        found = score(tried)
        search.tell(tried, found)
        if found > most if tuning.maximise else found < most:
            best, most = tried, found
    return best


def _parts(df: DataFrame, key: list[str], test: float, validation: float) -> DataFrame:
    """df with part: test, check (to hold settings against) or fit; by cell and label, each exact and the same on every run."""
    strata = [CELL, "label"]
    outer = train_test(df, key, training.SEED, test, strata)
    inner = train_test(outer.where("split = 'train'").drop("split"), key, training.SEED, validation / (1 - test), strata)
    inner = inner.select("*", F.when(F.col("split") == "test", "check").otherwise("fit").alias("part")).drop("split")
    return inner.unionByName(outer.where("split = 'test'").withColumnRenamed("split", "part"))


def _cells(data: DataFrame, across: bool) -> list[str]:
    """Cells of data; fails where one leaves nothing to learn from."""
    many = {r[0]: r[1] for r in data.groupBy(CELL).agg(F.count_if(F.col("part") != "test").alias("n")).limit(training.MOST_CELLS + 1).collect()}
    if len(many) > training.MOST_CELLS:
        raise ValueError(f"more than {training.MOST_CELLS} cells")
    bare = sorted(c for c, n in many.items() if (sum(many.values()) - n if across else n) == 0)
    if bare or not many:
        raise ValueError(f"no rows to learn from for {bare or 'any cell'}")
    return sorted(many)


def _by_cell(df: DataFrame, kind: str, key: list[str], across: bool, test: float, validation: float, settings: dict | None, tuning: Tuning | None, saved: str | None, runs: tuple[str, str] | None, parallel: int) -> Outcome:
    began = time.monotonic()
    ready, columns = _ready(df, key)
    data = settled(_parts(ready, key, 0.0 if across else test, validation))
    cells = _cells(data, across)
    found = dict(settings or (saved and writers.load_parameters(saved)) or {})
    others = (lambda c: data.where(F.col(CELL) != c)) if across else (lambda c: data.where(F.col(CELL) == c))
    if tuning is not None:
        found |= _at_a_time(df.sparkSession, lambda c: _best(others(c), kind, columns, tuning), [c for c in cells if c not in found], parallel)
        if saved:
            writers.parameters(found, saved)
    searched = time.monotonic()
    models = _at_a_time(df.sparkSession, lambda c: training.fit(others(c).where("part <> 'test'"), kind, columns, found.get(c)), cells, parallel)
    judged = {c: data.where(F.col(CELL) == c) if across else data.where((F.col(CELL) == c) & (F.col("part") == "test")) for c in cells}
    predictions = settled(training._union([_judged(judged[c], models[c], columns, c) for c in cells]))
    weights = [(c, f, w) for c in cells for f, w in training.weights(models[c], columns)]
    out = Outcome(predictions, models, weights, found, {"search": searched - began, "train_and_judge": time.monotonic() - searched})
    return _logged(out, kind, runs)


def within_cells(df: DataFrame, kind: str, key: list[str], test: float = TEST, validation: float = VALIDATION, settings: dict | None = None, tuning: Tuning | None = None, saved: str | None = None, runs: tuple[str, str] | None = None, parallel: int = PARALLEL) -> Outcome:
    """A model for each cell, of its own train rows, judged on its test rows.

    test and validation are shares of all rows. settings: by cell; without them those of the JSON file `saved` count, if it is there.
    With tuning, cells that have none yet are searched and saved. runs: (table of runs, name of this run)."""
    return _by_cell(df, kind, key, False, test, validation, settings, tuning, saved, runs, parallel)


def across_cells(df: DataFrame, kind: str, key: list[str], validation: float = VALIDATION, settings: dict | None = None, tuning: Tuning | None = None, saved: str | None = None, runs: tuple[str, str] | None = None, parallel: int = PARALLEL) -> Outcome:
    """A model for each cell, of all other cells' rows, judged on the cell's; arguments as for within_cells."""
    return _by_cell(df, kind, key, True, 0.0, validation, settings, tuning, saved, runs, parallel)


def by_folds(df: DataFrame, kind: str, key: list[str], k: int = 5, setting: dict | None = None, tuning: Tuning | None = None, saved: str | None = None, runs: tuple[str, str] | None = None, parallel: int = PARALLEL) -> Outcome:
    """Every row judged by the model that did not see its fold; models["all"] and the importances are of all rows.

    Folds are dealt by label. The setting is the best mean area under the curve over these folds."""
    began = time.monotonic()
    ready, columns = _ready(df, key)
    data = settled(folds(ready, key, training.SEED, k, ["label"]))
    if not data.take(1):
        raise ValueError("no rows to learn from")
    stored = (writers.load_parameters(saved) or {}) if saved else {}
    setting = setting if setting is not None else stored.get(ALL)
    if setting is None and tuning is not None:
        setting = training.optimise(data, kind, key, tuning.trials, k, tuning.maximise, tuning.space, tuning.seconds)[0]
        if saved:
            writers.parameters(stored | {ALL: setting}, saved)
    searched = time.monotonic()
    fold = F.col("fold")
    fitted = _at_a_time(df.sparkSession, lambda i: training.fit(data.where(fold != i) if i < k else data, kind, columns, setting), list(range(k + 1)), parallel)
    predictions = settled(training._union([_judged(data.where(fold == i), fitted[i], columns, ALL) for i in range(k)]))
    weights = [(ALL, f, w) for f, w in training.weights(fitted[k], columns)]
    out = Outcome(predictions, {ALL: fitted[k]}, weights, {ALL: setting or {}}, {"search": searched - began, "train_and_judge": time.monotonic() - searched})
    return _logged(out, kind, runs)


def _logged(out: Outcome, kind: str, runs: tuple[str, str] | None) -> Outcome:
    if runs is not None:
        table, name = runs
        values = {f"{r.grp}/{m}": round(r[m], 3) for r in out.metrics.collect() for m in evaluation.METRICS}  # a row for each cell
        values |= {f"seconds/{what}": s for what, s in out.seconds.items()}
        writers.log_run(out.predictions.sparkSession, table, name, values, {"model": kind} | {c: json.dumps(s, sort_keys=True) for c, s in out.settings.items()})
    return out


def write(out: Outcome, folder: str) -> None:
    """The run's tables and models below folder: metrics, confusion, curve and importances as TSV, predictions as Parquet."""
    for name in ("metrics", "confusion", "curve", "importances"):
        writers.tsv(getattr(out, name).coalesce(1), f"{folder}/{name}")  # at most 1,001 rows a cell
    writers.parquet(out.predictions, f"{folder}/predictions")
    for cell, model in out.models.items():
        writers.model(model, f"{folder}/models/{cell}")


def read_curve(spark: SparkSession, folder: str) -> DataFrame:
    """The points of write()'s curve, ready to draw."""
    return spark.read.csv(f"{folder}/curve", sep="\t", header=True, schema="grp string, score double, tpr double, fpr double").orderBy("grp", F.desc("score"))
