"""Ranks over whole tables or large groups without a window over either."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.llm import common


def ranked(df: DataFrame, group: list[str], order: list[Column | str]) -> DataFrame:
    """df, written, with _rank (0, 1, 2... within its group, in order) and _size (the group's rows). Group columns hold no nulls.

    Rows are range-partitioned and sorted by group and order, so that a group of any size is spread over tasks. A row's rank
    is its place in its task and the rows of its group in tasks before: prefix sums over a row for each task and group."""
    keys = [*group, *order]
    dealt = df.repartitionByRange(common.parts(df.sparkSession), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = common.written(dealt.withColumns({"_task": F.spark_partition_id(), "_place": place}))
    counts = placed.groupBy(*group, "_task").agg(F.count("*").alias("_many"), F.min("_place").alias("_first"))
    whole = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    before = F.sum("_many").over(whole.orderBy("_task").rowsBetween(W.unboundedPreceding, 0)) - F.col("_many")
    counts = counts.select(*group, "_task", (before - F.col("_first")).alias("_base"), F.sum("_many").over(whole).alias("_size"))
    return placed.join(counts, [*group, "_task"]).select(*df.columns, (F.col("_place") + F.col("_base")).alias("_rank"), "_size")
