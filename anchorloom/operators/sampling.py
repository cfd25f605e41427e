"""Exact, repeatable sampling: rows in order of md5(seed | key), cut at a quota for each stratum.

The cut is found from sums over 4,096 hash buckets, and rows are ranked within buckets only; so a stratum with a third of
all rows is no sort in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_hash(seed: int, key: list[str]) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


#: Cuts (at most 4,096 a stratum) up to which they are broadcast; beyond, they are joined by a shuffle.
MOST_CUTS = 200_000


def sample_exact(df: DataFrame, key: list[str], seed: int, quota: Column | int, strata: list[str] | None = None, keep: bool = False, ties: list[str] | None = None) -> DataFrame:
    """The first quota rows of each stratum; quota may use n, the stratum's number of rows. keep=True keeps all rows, with
    column chosen. Fewer rows than the quota: all are taken. Rows of one key come in order of the columns in ties.

    The cuts are found when this is called; then rows past them go before anything is shuffled."""
    strata = strata or []
    tagged = df.withColumn("_hash", order_hash(seed, key)).withColumn("_bucket", F.substring("_hash", 1, 3))
    sums = tagged.groupBy(*strata, "_bucket").agg(F.count("*").alias("_many"))
    line = W.partitionBy(*strata).orderBy("_bucket") if strata else W.orderBy("_bucket")
    whole = W.partitionBy(*strata) if strata else W.partitionBy(F.lit(0))
    sums = sums.withColumns({"_through": F.sum("_many").over(line.rowsBetween(W.unboundedPreceding, 0)), "n": F.sum("_many").over(whole)})
    quota = F.lit(quota) if isinstance(quota, int) else quota
    sums = sums.withColumn("_left", (quota - F.col("_through") + F.col("_many")).cast("long"))
    cuts = sums.select(*[F.col(s).alias(f"_s_{s}") for s in strata], F.col("_bucket").alias("_b"), "_left", "_many")
    if not keep:
        found = cuts.where("_left > 0").limit(MOST_CUTS + 1).collect()
        cuts = F.broadcast(df.sparkSession.createDataFrame(found, cuts.schema)) if len(found) <= MOST_CUTS else cuts.where("_left > 0")
    at = F.col("_bucket") == F.col("_b")
    for s in strata:
        at = at & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    placed = tagged.join(cuts, at)
    rank = F.row_number().over(W.partitionBy(*strata, "_bucket").orderBy("_hash", *key, *(ties or [])))
    out = placed.withColumn("chosen", rank <= F.col("_left"))
    return out.select(*df.columns, "chosen") if keep else out.where("chosen").select(*df.columns)


def sample_fraction(df: DataFrame, key: list[str], seed: int, fraction: float, strata: list[str] | None = None) -> DataFrame:
    """bround(n x fraction) rows of each stratum."""
    return sample_exact(df, key, seed, F.bround(F.col("n") * fraction).cast("long"), strata)


def train_test(df: DataFrame, key: list[str], seed: int, test: float, strata: list[str]) -> DataFrame:
    """df with split: test for bround(n x test) rows of each stratum, else train."""
    out = sample_exact(df, key, seed, F.bround(F.col("n") * test).cast("long"), strata, keep=True)
    return out.withColumn("split", F.when(F.col("chosen"), "test").otherwise("train")).drop("chosen")


def folds(df: DataFrame, key: list[str], seed: int, k: int, strata: list[str]) -> DataFrame:
    """df with fold 0 to k - 1: rows of a stratum in hash order, dealt in turn. Ranks come from bucket sums and ranks
    within buckets."""
    tagged = df.withColumn("_hash", order_hash(seed, key)).withColumn("_bucket", F.substring("_hash", 1, 3))
    sums = tagged.groupBy(*strata, "_bucket").agg(F.count("*").alias("_many"))
    before = F.sum("_many").over(W.partitionBy(*strata).orderBy("_bucket").rowsBetween(W.unboundedPreceding, 0)) - F.col("_many")
    sums = sums.select(*[F.col(s).alias(f"_s_{s}") for s in strata], F.col("_bucket").alias("_b"), before.alias("_before"))
    at = F.col("_bucket") == F.col("_b")
    for s in strata:
        at = at & F.col(s).eqNullSafe(F.col(f"_s_{s}"))
    rank = F.row_number().over(W.partitionBy(*strata, "_bucket").orderBy("_hash", *key)) - 1 + F.col("_before")
    return tagged.join(sums, at).withColumn("fold", (rank % k).cast("int")).select(*df.columns, "fold")
