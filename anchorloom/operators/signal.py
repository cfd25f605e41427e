"""Statistics of piecewise-constant signal over anchors, by interval arithmetic instead of one value for each base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, KEYS
from anchorloom.operators.intervals import overlap_join
from anchorloom.sources.settled import settled

STATS = ("mean", "weighted_mean", "min", "max")
MOST_TRACKS = 10_000


def _for_each(spots: DataFrame, tracks: DataFrame) -> DataFrame:
    """spots once for each track. Tracks are read when this is called; more than MOST_TRACKS fail."""
    found = tracks.limit(MOST_TRACKS + 1).collect()
    if len(found) > MOST_TRACKS:
        raise ValueError(f"more than {MOST_TRACKS} tracks")
    empty = F.array().cast(f"array<{tracks.schema.simpleString()}>")
    names = F.array(*[F.struct(*[F.lit(r[f.name]).cast(f.dataType).alias(f.name) for f in tracks.schema]) for r in found]) if found else empty
    return spots.select("*", F.explode(names).alias("_track")).select(*spots.columns, "_track.*")


def kernel(t: Column, k: Column) -> Column:
    """Sum of the first t weights 1, 2, ... up and down again of a triangle k wide."""
    half = F.floor((k + 1) / 2)
    return F.when(t <= half, t * (t + 1) / 2).otherwise(kernel_sum(k) - (k - t) * (k - t + 1) / 2)


def kernel_sum(k: Column) -> Column:
    return F.floor(k / 2) * (F.floor(k / 2) + 1) + F.when(k % 2 == 1, F.floor((k + 1) / 2)).otherwise(F.lit(0))


def signal_stats(spots: DataFrame, runs: DataFrame, res: int = 20, extra: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (cell_type, chr, start, end) with STATS of runs (cell_type, chr, start, end, value, *extra), gaps as 0.

    min and max are those of means over blocks of res bases. Blocks inside one run need no sum; only the two at its edges
    do, so a row stands for a run and not for a block. extra columns (a track, say) multiply the spots."""
    keys = (*KEYS, *extra)
    base = spots.select(*KEYS, "start", "end").distinct()
    if extra:
        base = _for_each(base, runs.select(*extra).distinct())
    base = base.withColumn("k", F.col("end") - F.col("start"))
    met = overlap_join(base, runs.select(*keys, "start", "end", "value"), keys)
    o0, o1, k, v = F.greatest("a_start", "b_start") - F.col("a_start"), F.least("a_end", "b_end") - F.col("a_start"), F.col("a_k"), F.col("b_value")
    met = met.select(*keys, F.col("a_start").alias("start"), F.col("a_end").alias("end"), k.alias("k"), v.alias("v"), o0.alias("o0"), o1.alias("o1"))
    o0, o1, k, v = (F.col(c) for c in ("o0", "o1", "k", "v"))
    first, last = F.ceil(o0 / res), F.floor(o1 / res)
    part = lambda block, amount: F.struct(block.alias("block"), amount.alias("amount"), F.lit(0).cast("long").alias("blocks"))
    inner = F.struct(F.lit(-2).cast("long").alias("block"), (v * 0).alias("amount"), F.greatest(last - first, F.lit(0)).alias("blocks"))
    edges = F.when(first > last, F.array(inner, part(last, v * (o1 - o0)))).otherwise(F.array(inner, part(first - 1, v * (first * res - o0)), part(last, v * (o1 - last * res))))
    rows = met.select("*", (v * (o1 - o0)).alias("area"), (v * (kernel(o1, k) - kernel(o0, k)) / kernel_sum(k)).alias("weighted"), F.explode(edges).alias("e"))
    rows = rows.where("e.block = -2 or (e.block = o0 div {0} and o0 % {0} <> 0) or (e.block = o1 div {0} and o1 % {0} <> 0)".format(res))
    spot = [*keys, "start", "end", "k"]
    inside = F.col("e.block") == -2
    blocks = rows.groupBy(*spot, F.col("e.block").alias("block")).agg(
        F.sum(F.when(inside, F.col("area"))).alias("area"),
        F.sum(F.when(inside, F.col("weighted"))).alias("weighted"),
        F.sum("e.blocks").alias("full"),
        F.min(F.when(inside & (F.col("e.blocks") > 0), v)).alias("low"),
        F.max(F.when(inside & (F.col("e.blocks") > 0), v)).alias("high"),
        (F.sum("e.amount") / res).alias("edge"),
    )
    edge = F.when(F.col("block") >= 0, F.col("edge"))
    one = blocks.groupBy(*spot).agg(
        (F.sum("area") / F.first("k")).alias("mean"),
        F.sum("weighted").alias("weighted_mean"),
        F.min(F.least("low", edge)).alias("low"),
        F.max(F.greatest("high", edge)).alias("high"),
        F.sum(F.when(F.col("block") >= 0, 1).otherwise(F.col("full"))).alias("covered"),
    )
    gap = F.col("covered") * res < F.col("k")
    one = one.select(*keys, "start", "end", "mean", "weighted_mean", F.when(gap, F.least("low", F.lit(0.0))).otherwise(F.col("low")).alias("min"), F.when(gap, F.greatest("high", F.lit(0.0))).otherwise(F.col("high")).alias("max"))
    out = base.drop("k").join(one, [*keys, "start", "end"], "left")
    return out.select(*keys, "start", "end", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in STATS])


def normalised(pairs: DataFrame, stats: DataFrame, experiment: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """pairs with {x,y}_<experiment>_<stat>, divided by the cell's average of mean over distinct anchors of both sides.

    stats are settled when this is called: the average and both sides read them."""
    stats = settled(stats)
    average = stats.groupBy(CELL, *extra).agg(F.avg("mean").alias("_level"))
    level = stats.join(average, [CELL, *extra])
    level = level.select(CELL, "chr", *extra, "start", "end", *[(F.col(s) / F.col("_level")).alias(s) for s in STATS])
    out = pairs
    for side in "xy":
        one = level.select(CELL, "chr", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), *[F.col(s).alias(f"{side}_{experiment}_{s}") for s in STATS])
        out = out.join(one, [CELL, "chr", f"{side}_start", f"{side}_end"], "left")
    return out


def tracks_wide(pairs: DataFrame, stats: DataFrame, tracks: list[str]) -> DataFrame:
    """pairs with {x,y}_<track>_<stat> for many tracks of one cell: one pivot instead of a join for each track.

    stats are settled when this is called, and so is the wide table."""
    stats = settled(stats)
    average = stats.groupBy(CELL, "track").agg(F.avg("mean").alias("_level"))  # a row for each cell and track
    level = stats.join(average, [CELL, "track"])
    wide = settled(level.groupBy(CELL, "chr", "start", "end").pivot("track", tracks).agg(*[F.first(F.col(s) / F.col("_level")).alias(s) for s in STATS]))
    names = [c for c in wide.columns if c not in (CELL, "chr", "start", "end")]
    out = pairs
    for side in "xy":
        one = wide.select(CELL, "chr", F.col("start").alias(f"{side}_start"), F.col("end").alias(f"{side}_end"), *[F.col(f"`{c}`").alias(f"{side}_{c}") for c in names])
        out = out.join(one, [CELL, "chr", f"{side}_start", f"{side}_end"], "left")
    return out
