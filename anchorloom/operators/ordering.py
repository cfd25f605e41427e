"""Running sums and ranks along large groups, from sums by bin and windows within bins only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def running_sum(df: DataFrame, group: list[str], bins: list[str], order: list[Column | str], value: Column, out: str) -> DataFrame:
    """df with out: the sum of value over the group's rows up to and with this one, in order of bins, then order.

    Rows are sorted within a bin only; what bins before it hold is a window over one row for each bin. df is planned twice.
    The window's partitions are those of the join, so merging costs no shuffle, and bins may be as many as rows: never a broadcast.
    Columns of group and bins hold no nulls; rows that tie in order and bin are summed one after another."""
    tagged = df.withColumn("_value", value)
    sums = tagged.groupBy(*group, *bins).agg(F.sum("_value").alias("_many"))
    before = F.sum("_many").over(W.partitionBy(*group).orderBy(*bins).rowsBetween(W.unboundedPreceding, 0)) - F.col("_many")
    sums = sums.select(*group, *bins, before.alias("_before"))
    own = F.sum("_value").over(W.partitionBy(*group, *bins).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return tagged.withColumn("_own", own).join(sums.hint("merge"), [*group, *bins]).select(*df.columns, (F.col("_own") + F.col("_before")).alias(out))
