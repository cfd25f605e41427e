"""Densities of a column by group: Gaussian kernels over counts on a grid, evaluated at evenly spaced points.

1. One grouped pass gives each group's size, range and deviation; the bandwidth follows (Scott: deviation x n^-1/5).
2. Each value is split over the two nodes around it on a grid of bandwidth / FINE. A cell's number of values and sum of
   fractions say what both nodes get, so a second pass with partial sums leaves a row for each cell in use: at most about
   FINE x range / bandwidth of them, whatever the number of rows.
3. Each node adds its kernel to the points within REACH bandwidths. The rows of this step depend on FINE, REACH and the
   number of points only.

Values that are null, NaN or infinite are left out; a null in the group columns is a group. Groups whose values are all
equal have no deviation and, unless a bandwidth is given, no density: no row. An empty table gives an empty result;
extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.sources.settled import settled

FINE, REACH, MOST_GROUPS, SALTS = 16, 6, 100_000, 16
_GROUP, _VALUE = "_density_g{}", "_density_value"


def _stats(values: DataFrame, group: list[str], points: int, cut: float, bandwidth: float | None) -> DataFrame:
    width = F.lit(float(bandwidth)) if bandwidth else F.stddev_samp(_VALUE) * F.pow(F.count("*"), F.lit(-0.2))
    out = values.groupBy(*group).agg(F.count("*").alias("n"), F.min(_VALUE).alias("lowest"), F.max(_VALUE).alias("highest"), width.alias("width"))
    out = out.where("width > 0" if bandwidth else "width > 0 and lowest < highest")
    first, last = F.col("lowest") - cut * F.col("width"), F.col("highest") + cut * F.col("width")
    return out.withColumns({"fine": F.col("width") / FINE, "first": first, "step": (last - first) / (points - 1)})


def densities(df: DataFrame, by: list[str], column: str, points: int = 200, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """(by, point, at, density): points evenly spaced from `cut` bandwidths below a group's least value to as many above its greatest.

    The statistics of groups are settled when this is called; up to MOST_GROUPS of them are broadcast, more meet the rows by a salted join."""
    if points < 2:
        raise ValueError("at least two points")
    group = [_GROUP.format(i) for i in range(len(by))]
    values = df.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(by, group, strict=True)], F.col(f"`{column}`").cast("double").alias(_VALUE))
    values = values.where(F.col(_VALUE).isNotNull() & ~F.isnan(_VALUE) & (F.abs(_VALUE) < math.inf))
    stats = settled(_stats(values, group, points, cut, bandwidth))
    cells = _cells(values, stats, group)
    held = ["n", "lowest", "width", "fine", "first", "step"]
    node = lambda at, mass: F.struct(F.expr(at).alias("node"), F.expr(mass).alias("mass"))
    nodes = cells.select(*group, *held, F.inline(F.array(node("cell", "many - parts"), node("cell + 1", "parts"))))
    nodes = nodes.withColumn("place", F.col("lowest") + F.col("node") * F.col("fine"))
    low = F.greatest(F.lit(0), F.ceil((F.col("place") - REACH * F.col("width") - F.col("first")) / F.col("step"))).cast("int")
    high = F.least(F.lit(points - 1), F.floor((F.col("place") + REACH * F.col("width") - F.col("first")) / F.col("step"))).cast("int")
    near = nodes.withColumns({"low": low, "high": high}).where("low <= high and mass > 0").withColumn("point", F.explode(F.sequence("low", "high")))
    away = (F.col("first") + F.col("point") * F.col("step") - F.col("place")) / F.col("width")
    height = F.col("mass") * F.exp(-away * away / 2) / (F.col("n") * F.col("width") * math.sqrt(2 * math.pi))
    at = F.col("first") + F.col("point") * F.col("step")
    # Every point has a row, those that no kernel reaches too.
    bare = stats.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).select(*group, "point", at.alias("at"), F.lit(0.0).alias("height"))
    out = near.select(*group, "point", at.alias("at"), height.alias("height")).unionByName(bare)
    out = out.groupBy(*group, "point").agg(F.max("at").alias("at"), F.sum("height").alias("density"))
    return out.select(*[F.col(g).alias(c) for g, c in zip(group, by, strict=True)], "point", "at", "density")


def _cells(values: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """(group, its statistics, cell, many, parts): how many values lie in a cell of the grid, and the sum of their fractions."""
    own = stats.select(*[F.col(g).alias(f"{g}_") for g in group], "n", "lowest", "width", "fine", "first", "step")
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_"))
    if stats.limit(MOST_GROUPS + 1).count() <= MOST_GROUPS:
        joined = values.join(F.broadcast(own), same)
    else:  # a group with a third of all rows is SALTS tasks
        salted = own.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = values.withColumn("_density_salt", F.pmod(F.xxhash64(_VALUE), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("_density_salt") == F.col("salt_")))
    place = (F.col(_VALUE) - F.col("lowest")) / F.col("fine")
    out = joined.withColumns({"cell": F.floor(place).cast("long"), "part": place - F.floor(place)})
    return out.groupBy(*group, "n", "lowest", "width", "fine", "first", "step", "cell").agg(F.count("*").alias("many"), F.sum("part").alias("parts"))
