"""Metrics of hard predictions, curves, correlations and distributions, each from one grouped pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

METRICS = ("accuracy", "precision", "recall", "f1", "roc_auc", "mcc")


def _over(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def confusion(df: DataFrame, by: str = "grp", label: str = "label", pred: str = "pred") -> DataFrame:
    is_ = lambda a, b: F.count_if((F.col(label) == a) & (F.col(pred) == b))
    return df.groupBy(by).agg(is_(1, 1).alias("tp"), is_(0, 1).alias("fp"), is_(1, 0).alias("fn"), is_(0, 0).alias("tn"))


def binary_metrics(df: DataFrame, by: str = "grp", label: str = "label", pred: str = "pred") -> DataFrame:
    """METRICS for each group; roc_auc is that of hard predictions; ratios over nothing are 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    out = confusion(df, by, label, pred)
    return out.select(
        by,
        _over(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        _over(tp, tp + fp).alias("precision"),
        _over(tp, tp + fn).alias("recall"),
        _over(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ((_over(tp, tp + fn) + _over(tn, tn + fp)) / 2).alias("roc_auc"),
        _over(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))).alias("mcc"),
    )


def mean_metrics(metrics: DataFrame) -> DataFrame:
    return metrics.agg(*[F.avg(m).alias(m) for m in METRICS])


def roc_points(df: DataFrame, by: str = "grp", label: str = "label", score: str = "pred") -> DataFrame:
    """(by, score, tpr, fpr) at each distinct score: sums over scores, of which hard predictions have two."""
    per = df.groupBy(by, F.col(score).alias("score")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    down = W.partitionBy(by).orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(by)
    return per.select(by, "score", _over(F.sum("p").over(down).cast("double"), F.sum("p").over(whole)).alias("tpr"), _over(F.sum("n").over(down).cast("double"), F.sum("n").over(whole)).alias("fpr"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr) of every two columns, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("corr")) for a, b in pairs])))


def quantiles(df: DataFrame, by: str, column: str, at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    return df.groupBy(by).agg(F.min(column).alias("lowest"), *[F.percentile(column, q).alias(f"q{int(100 * q)}") for q in at], F.max(column).alias("highest"))


def top(df: DataFrame, by: str, n: int = 20, ties: list[str] | None = None) -> DataFrame:
    """The n rows of largest `by`; equal ones in order of the columns in ties."""
    return df.orderBy(F.desc(by), *(ties or [])).limit(n)
