"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame operations only.

Each document gets an exponential key -ln(u)/w: u from a hash of the row, w its quality weight. A source's documents in
order of key, prefix-summed in words, fill what its target leaves after complete epochs; the document at the boundary
is cut (or, with boundary="nearest", taken whole if at least half of it fits).

The prefix sum never sorts a source: words are summed by key bucket, the bucket in which the budget ends is found per
source, and only that bucket is summed by key. What then decides about a document is one row for each source.

Defined cases: null text has size 0 and is never taken; null source is a source of its own, last in order; rows that
share doc_id and text share their key and split what is left in proportion; an empty table gives an empty result; extra
columns stay, and helper columns bear reserved names (prefix _mix_).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.llm import common
from anchorloom.llm.native_text import SYMBOLS, count_of, whole, word_array

BUCKETS, SEED = 4096, 20240229


def quality_weight() -> Column:
    """0.1 to 1: less for texts full of markup symbols."""
    return F.greatest(F.lit(0.1), 1 - 5 * count_of(whole(), SYMBOLS) / F.greatest(F.length(whole()), F.lit(1)))


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """docs with _mix_size (words), _mix_key and _mix_bucket (monotone in the key)."""
    u = (F.xxhash64(F.col("doc_id"), whole(), F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) + 0.5) / float(1 << 53)
    out = docs.withColumns({"_mix_size": F.size(word_array()).cast("long"), "_mix_key": -F.log(u) / quality_weight()})
    return out.withColumn("_mix_bucket", F.floor(BUCKETS * (1 - F.exp(-F.col("_mix_key")))).cast("int"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), ratio: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): shares of ratio x all words by repeating weights, each
    at most cap x its source. The level at which targets stop rising is found from sorted breakpoints, not by rounds."""
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ordered = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    stop = ordered.select("source", "source_size", "rank", weight.alias("w"), (cap * F.col("source_size")).alias("cap"))
    stop = stop.withColumn("at", F.col("cap") / F.col("w"))
    rising = W.orderBy("at", "rank")
    before = F.coalesce(F.sum("cap").over(rising.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(rising.rowsBetween(W.currentRow, W.unboundedFollowing))
    level = (ratio * F.sum("source_size").over(everything) - before) / rest
    found = stop.withColumn("level", level).withColumn("level", F.min(F.when(F.col("level") <= F.col("at"), F.struct("at", "rank", "level"))).over(everything)["level"])
    return found.select("source", "source_size", F.least("cap", F.coalesce(F.col("level") * F.col("w"), F.col("cap"))).alias("target"))


def boundaries(rows: DataFrame, **shares) -> DataFrame:
    """One row for each source: its target, complete epochs, and the key at which its fractional selection ends."""
    buckets = common.written(rows.groupBy("source", F.col("_mix_bucket").alias("bucket")).agg(F.sum("_mix_size").alias("words")))
    goal = targets(buckets.groupBy("source").agg(F.sum("words").alias("source_size")), **shares)
    budget = F.round("target").cast("long")
    goal = goal.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0)))
    goal = common.written(goal.withColumn("rest", budget - F.col("epochs") * F.col("source_size")))
    up_to = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = buckets.withColumn("through", F.sum("words").over(up_to))
    met = summed.alias("b").join(goal.alias("g"), F.col("b.source").eqNullSafe(F.col("g.source")))
    end = met.where("through >= rest and through - words < rest").select(F.col("g.source").alias("source"), "bucket", (F.col("rest") - F.col("through") + F.col("words")).alias("room"))
    end = common.written(end)
    inside = rows.alias("r").join(at_hand(end).alias("e"), F.col("r.source").eqNullSafe(F.col("e.source")) & (F.col("_mix_bucket") == F.col("bucket")))
    keys = inside.groupBy(F.col("r.source").alias("source"), F.col("_mix_key").alias("key"), "room").agg(F.sum("_mix_size").alias("words"))
    keys = keys.withColumn("through", F.sum("words").over(W.partitionBy("source").orderBy("key").rowsBetween(W.unboundedPreceding, W.currentRow)))
    last = keys.where("through >= room and through - words < room").select("source", F.col("key").alias("end_key"), (F.col("room") - F.col("through") + F.col("words")).alias("end_room"), F.col("words").alias("end_words"))
    out = goal.alias("g").join(last.alias("l"), F.col("g.source").eqNullSafe(F.col("l.source")), "left")
    out = out.select(F.col("g.source").alias("_mix_source"), "source_size", "target", "epochs", "end_key", "end_room", "end_words")
    return common.written(out)


def at_hand(sources: DataFrame, limit: int = 100_000) -> DataFrame:
    """A table with a row for each source: broadcast up to `limit` rows; beyond, a shuffled join whose skew Spark splits."""
    return F.broadcast(sources) if sources.count() <= limit else sources


def decided(rows: DataFrame, ends: DataFrame, boundary: str = "cut") -> DataFrame:
    """rows of sized() with source_size, target and _mix_taken: words the mix takes, repeats counted."""
    out = rows.join(at_hand(ends), F.col("source").eqNullSafe(F.col("_mix_source")), "left")
    part = F.expr("cast(floor(end_room * _mix_size / end_words) as bigint)")
    if boundary == "nearest":
        part = F.when(2 * part >= F.col("_mix_size"), F.col("_mix_size")).otherwise(F.lit(0))
    extra = F.when(F.col("_mix_key") < F.col("end_key"), F.col("_mix_size")).when(F.col("_mix_key") == F.col("end_key"), part).otherwise(F.lit(0))
    return out.withColumn("_mix_taken", F.col("epochs") * F.col("_mix_size") + extra)


def mix(docs: DataFrame, boundary: str = "cut", seed: int = SEED, **shares) -> DataFrame:
    """docs with source_size, target and _mix_taken."""
    rows = sized(docs, seed)
    slim = common.written(rows.select("source", "_mix_size", "_mix_key", "_mix_bucket"))
    return decided(rows, boundaries(slim, **shares), boundary)


def summary(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """(doc_id, size, source_size, target, taken): texts are read once."""
    slim = common.written(sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    return decided(slim, boundaries(slim, **shares)).select("doc_id", F.col("_mix_size").alias("size"), "source_size", "target", F.col("_mix_taken").alias("taken"))


def mixed(docs: DataFrame, seed: int = SEED, **shares) -> DataFrame:
    """docs as the mix has them: whole documents, as many rows as times taken; no other columns."""
    row = docs.select("doc_id", "source", "text", F.struct("*").alias("_mix_row"))
    out = mix(row, "nearest", seed, **shares)
    times = F.when(F.col("_mix_size") > 0, F.expr("_mix_taken div _mix_size")).otherwise(F.lit(0)).cast("int")
    return out.withColumn("_mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select("_mix_row.*")
