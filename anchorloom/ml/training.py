"""Training and evaluation with pyspark.ml: four model families, within cells, across cells, by folds, and a search."""

from __future__ import annotations

import time
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL
from anchorloom.ml.search import Range, Search, Space
from anchorloom.operators import evaluation
from anchorloom.operators.features import COORDINATES
from anchorloom.operators.sampling import folds, sample_fraction, train_test
from anchorloom.sources import writers
from anchorloom.sources.settled import settled

SEED, MOST_CELLS = 42, 1000
#: Names used elsewhere for the same settings.
RENAMED = {"n_estimators": {"random_forest": "numTrees", "gradient_boosting": "maxIter"}, "max_depth": "maxDepth", "criterion": "impurity", "min_samples_leaf": "minInstancesPerNode", "min_child_samples": "minInstancesPerNode", "min_impurity_decrease": "minInfoGain", "min_split_gain": "minInfoGain", "min_weight_fraction_leaf": "minWeightFractionPerNode", "subsample": "subsamplingRate", "learning_rate": "stepSize", "max_bin": "maxBins", "tol": "tol", "bootstrap": "bootstrap", "max_features": "featureSubsetStrategy"}
_DEPTHS = [10, 20, 30, 40, 50, 60, 70, 80, 90, 100, 1000, 10000]
#: The ranges that settings are searched in, by their common names. Those without a counterpart here change nothing.
SPACES: dict[str, Space] = {
    "logistic_regression": {"C": Range(0.1, 10, 0.1), "tol": Range(0.000001, 0.001)},
    "random_forest": {
        "criterion": ["gini", "entropy"], "n_estimators": Range(100, 1000, 50, True), "max_depth": _DEPTHS, "min_samples_leaf": Range(1, 10, 1, True),
        "min_weight_fraction_leaf": Range(0, 0.5, 0.1), "min_impurity_decrease": Range(0, 0.5, 0.1), "bootstrap": [True, False],
    },
    "gradient_boosting": {
        "max_depth": Range(-1, 20, 5, True), "min_child_samples": Range(10, 100, 10, True), "max_bin": Range(200, 300, 25, True), "learning_rate": Range(0.01, 0.51, 0.1),
        "n_estimators": [50, 100, 150, 200], "min_split_gain": Range(0, 10, 1, True), "subsample": Range(0.3, 1, 0.1),
    },
    "decision_tree": {
        "criterion": ["gini", "entropy"], "max_depth": _DEPTHS, "min_samples_leaf": Range(1, 10, 1, True), "min_weight_fraction_leaf": Range(0, 0.5, 0.1), "min_impurity_decrease": Range(0, 0.5, 0.1),
    },
}


def estimator(kind: str, parameters: dict | None = None, rows: int = 1):
    """An estimator of the family; settings by their common names, those without a counterpart are returned as dropped."""
    made = {"logistic_regression": lambda: LogisticRegression(standardization=False, regParam=1 / max(1, rows)), "random_forest": lambda: RandomForestClassifier(seed=SEED, numTrees=50), "gradient_boosting": lambda: GBTClassifier(seed=SEED, maxIter=20), "decision_tree": lambda: DecisionTreeClassifier(seed=SEED)}
    if kind not in made:
        raise ValueError(f"model must be one of {sorted(made)}")
    model, dropped = made[kind](), []
    for name, value in (parameters or {}).items():
        target = RENAMED.get(name)
        target = target.get(kind) if isinstance(target, dict) else target
        if name == "C" and kind == "logistic_regression":
            model.setRegParam(1 / (value * max(1, rows)))
        elif target and model.hasParam(target):
            if target == "maxDepth":
                value = 30 if value is None or value < 0 else min(value, 30)
            elif target == "minWeightFractionPerNode":
                value = min(value, 0.5 - 1e-9)  # a half is not allowed here; no split has more on both sides
            model._set(**{target: value})
        else:
            dropped.append(name)
    return model, dropped


def inputs(df: DataFrame, key: Iterable[str] = ()) -> list[str]:
    """Numeric columns to learn from."""
    skip = {*COORDINATES, CELL, "label", "split", "fold", *key}
    return [c for c, t in df.dtypes if c not in skip and t.split("(")[0] in {"int", "bigint", "smallint", "tinyint", "float", "double", "decimal"}]


def fit(df: DataFrame, kind: str, columns: list[str], parameters: dict | None = None) -> PipelineModel:
    """A fitted model, assembler included. Columns whose names hold dots are renamed inside."""
    safe = [c.replace(".", "_") for c in columns]
    ready = df.select(*[F.col(f"`{c}`").cast("double").alias(s) for c, s in zip(columns, safe, strict=True)], F.col("label").cast("double").alias("label"))
    model, _ = estimator(kind, parameters, ready.count() if kind == "logistic_regression" else 1)
    assembled = VectorAssembler(inputCols=safe, outputCol="features", handleInvalid="skip")
    return PipelineModel([assembled, model.fit(assembled.transform(ready))])


def predict(df: DataFrame, model: PipelineModel, columns: list[str]) -> DataFrame:
    out = df.withColumns({c.replace(".", "_"): F.col(f"`{c}`").cast("double") for c in columns if "." in c})
    out = model.transform(out)
    return out.withColumn("prediction", F.col("prediction").cast("int"))


def read_data(df: DataFrame, cells: list[str] | None = None, key: list[str] | None = None, fraction: float | None = None) -> DataFrame:
    out = df if cells is None else df.where(F.col(CELL).isin(cells))
    return out if fraction is None else sample_fraction(out, key or ["chr", "x", "y"], SEED, fraction, [CELL, "label"])


def cells_of(df: DataFrame) -> list[str]:
    """Cells are few: models are fitted for each in turn. More than MOST_CELLS fail."""
    found = df.select(CELL).distinct().limit(MOST_CELLS + 1).collect()
    if len(found) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    return sorted(r[0] for r in found)


def audit(split: DataFrame, key: list[str]) -> DataFrame:
    """(cell_type, label, train, test) rows of a split; a key that lies on both sides fails."""
    if split.groupBy(*key).agg(F.count_distinct("split").alias("sides")).where("sides > 1").limit(1).count():
        raise ValueError("a row is in train and in test")
    return split.groupBy(CELL, "label").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


def hold_out_score(df: DataFrame, kind: str, key: list[str], test: float = 0.3, parameters: dict | None = None, metric: str = "roc_auc") -> float:
    """One of evaluation.METRICS of one setting's hard predictions on held-out rows; roc_auc unless another is named."""
    columns, data = inputs(df, key), train_test(df, key, SEED, test, ["label"])
    model = fit(data.where("split = 'train'"), kind, columns, parameters)
    made = predict(data.where("split = 'test'"), model, columns).select(F.lit("all").alias("grp"), "label", F.col("prediction").alias("pred"))
    found = evaluation.binary_metrics(made).select(metric).first()
    return found[0] if found else 0.0


def search_cells(df: DataFrame, kind: str, key: list[str], saved: str | None = None, **search) -> dict[str, dict]:
    """The best setting of each cell, from optimise(); with saved, settings found there are kept and new ones added."""
    best = (writers.load_parameters(saved) if saved else None) or {}
    for cell in cells_of(df):
        if cell not in best:
            best[cell] = optimise(df.where(F.col(CELL) == cell), kind, key, **search)[0]
    if saved:
        writers.parameters(best, saved)
    return best


def timed(df: DataFrame, kind: str, key: list[str], runs: str, run: str, parameters: dict | None = None) -> DataFrame:
    """within(), its means and the seconds it took appended to the table of runs."""
    began = time.monotonic()
    metrics = settled(within(df, kind, key, parameters=parameters))
    means = evaluation.mean_metrics(metrics).first().asDict()
    writers.log_run(df.sparkSession, runs, run, {k: v for k, v in means.items() if v is not None} | {"seconds": time.monotonic() - began}, {"model": kind})
    return metrics


def refitted(df: DataFrame, kind: str, key: list[str], parameters: dict | None = None) -> tuple[PipelineModel, DataFrame]:
    """The model of all rows and the importances of its columns."""
    columns = inputs(df, key)
    model = fit(df, kind, columns, parameters)
    return model, importances(model, columns, df.sparkSession)


def within(df: DataFrame, kind: str, key: list[str], test: float = 0.3, parameters: dict | None = None) -> DataFrame:
    """Metrics of each cell's model on the cell's own test rows."""
    columns = inputs(df, key)
    data = settled(train_test(df, key, SEED, test, [CELL, "label"]))
    parts = []
    for cell in cells_of(data):
        own = data.where(F.col(CELL) == cell)
        model = fit(own.where("split = 'train'"), kind, columns, parameters)
        parts.append(predict(own.where("split = 'test'"), model, columns).select(F.col(CELL).alias("grp"), "label", F.col("prediction").alias("pred")))
    return evaluation.binary_metrics(_union(parts))


def across(df: DataFrame, kind: str, key: list[str] | None = None, parameters: dict | None = None) -> DataFrame:
    """Metrics on each cell of a model fitted on all others."""
    columns = inputs(df, key or ["doc_id"])
    data, parts = settled(df), []
    for cell in cells_of(data):
        model = fit(data.where(F.col(CELL) != cell), kind, columns, parameters)
        parts.append(predict(data.where(F.col(CELL) == cell), model, columns).select(F.col(CELL).alias("grp"), "label", F.col("prediction").alias("pred")))
    return evaluation.binary_metrics(_union(parts))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _by_fold(df: DataFrame, kind: str, key: list[str], k: int, parameters: dict | None) -> list[DataFrame]:
    """Predictions of each fold; df may have its folds already."""
    from pyspark.ml.functions import vector_to_array

    columns = inputs(df, key)
    data = df if "fold" in df.columns else settled(folds(df, key, SEED, k, ["label"]))
    each = [(data.where(F.col("fold") == i), data.where(F.col("fold") != i)) for i in range(k)]
    return [predict(own, fit(rest, kind, columns, parameters), columns).select("label", "prediction", vector_to_array("probability")[1].alias("p")) for own, rest in each]


def cross_predicted(df: DataFrame, kind: str, key: list[str], k: int = 10, parameters: dict | None = None) -> DataFrame:
    """(label, prediction, p) of every row by the model that did not see its fold."""
    return _union(_by_fold(df, kind, key, k, parameters))


def cross_score(df: DataFrame, kind: str, key: list[str], k: int = 3, parameters: dict | None = None) -> float:
    """Mean over folds of the area under the curve of a fold's probabilities: scores of different models do not mix."""
    scorer = BinaryClassificationEvaluator(rawPredictionCol="p")
    found = [scorer.evaluate(f.withColumn("label", F.col("label").cast("double"))) for f in _by_fold(df, kind, key, k, parameters)]
    return sum(found) / len(found)


def optimise(df: DataFrame, kind: str, key: list[str], trials: int = 20, k: int = 3, maximise: bool = True, space: Space | None = None, seconds: float | None = None) -> tuple[dict, float]:
    """The best of the settings that a Search tries, or the defaults ({}) if none beats them, and its cross_score()."""
    search, started = Search(space or SPACES[kind], SEED, maximise), time.monotonic()
    df = df if "fold" in df.columns else settled(folds(df, key, SEED, k, ["label"]))  # all settings are held against the same folds
    best, score = {}, cross_score(df, kind, key, k)
    for _ in range(trials):
        if seconds is not None and time.monotonic() - started > seconds:
            break
        tried = search.ask()
        found = cross_score(df, kind, key, k, tried)
        search.tell(tried, found)
        if found > score if maximise else found < score:
            best, score = tried, found
    return best, score


def weights(model: PipelineModel, columns: list[str], n: int = 20) -> list[tuple[str, float]]:
    """The n columns of largest weight and it: coefficients of a regression, impurity gains of trees."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    return sorted(zip(columns, map(float, values.toArray()), strict=True), key=lambda r: (-abs(r[1]), r[0]))[:n]


def importances(model: PipelineModel, columns: list[str], spark, n: int = 20) -> DataFrame:
    """(feature, importance), largest first."""
    return spark.createDataFrame(weights(model, columns, n), "feature string, importance double")


def linear_shap(df: DataFrame, model: PipelineModel, columns: list[str]) -> DataFrame:
    """Contribution coefficient x (value - mean) of every column, for a regression."""
    weights = dict(zip(columns, map(float, model.stages[-1].coefficients), strict=True))
    means = df.agg(*[F.avg(f"`{c}`").alias(c) for c in columns]).first()
    return df.select(*[((F.col(f"`{c}`") - means[c]) * weights[c]).alias(c) for c in columns])
