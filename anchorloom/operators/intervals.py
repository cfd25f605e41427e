"""Interval joins as binned equi-joins and as-of carries: no cartesian product, no window over a whole chromosome.

Bins bound how many rows a task compares however long a chromosome is or however many rows a cell has; a row is copied
to each bin it touches (two at most where bins are as wide as intervals).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from anchorloom.functions.genomic import KEYS, overlaps

BIN = 8192


def binned(df: DataFrame, name: str, width: int = BIN, start: str = "start", end: str = "end") -> DataFrame:
    """df with a row for each bin that [start, end) touches, in column name; empty intervals are in none."""
    touched = F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))
    return df.where(F.col(start) < F.col(end)).withColumn(name, F.explode(touched))


def overlap_join(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """Pairs that overlap: keys, a_start, a_end, b_start, b_end and the other columns as a_<name>, b_<name>.

    Each pair comes out once, in the bin where the later of the two starts lies. A merge join: rows are copied to bins, which
    estimates do not see, so a broadcast could bring a large side to the driver."""
    left = binned(a, "_bin", width).select(*keys, "_bin", *[F.col(c).alias(f"a_{c}") for c in a.columns if c not in keys])
    right = binned(b, "_bin", width).select(*keys, "_bin", *[F.col(c).alias(f"b_{c}") for c in b.columns if c not in keys])
    met = left.hint("merge").join(right, [*keys, "_bin"])
    once = F.col("_bin") == F.floor(F.greatest("a_start", "b_start") / width)
    return met.where(overlaps(F.col("a_start"), F.col("a_end"), F.col("b_start"), F.col("b_end")) & once).drop("_bin")


def overlap_segments(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Overlapping pairs with the common part as start and end."""
    return overlap_join(a, b, keys).withColumns({"start": F.greatest("a_start", "b_start"), "end": F.least("a_end", "b_end")})


def overlap_count(a: DataFrame, b: DataFrame, name: str = "cnt", keys: tuple[str, ...] = KEYS, width: int = 1 << 17) -> DataFrame:
    """a's distinct (keys, start, end) with the number of rows of b that overlap each; zero is kept.

    No pair is made: the count is the starts before a spot's end less the ends up to its start. Both are running sums
    within bins, with a carry over bin sums, so dense bins cost what they hold."""
    spots = a.select(*keys, "start", "end").distinct()
    rows = b.where(F.col("start") < F.col("end")).dropna("any", subset=list(keys))

    # At one place ends come first (turn 0), then spots (1), then starts (2), as intervals are half-open.
    def mark(place: str, turn: int, s: int, e: int):
        return F.struct(F.col(place).cast("long").alias("p"), F.lit(turn).alias("turn"), F.lit(s).cast("long").alias("s"), F.lit(e).cast("long").alias("e"), F.lit(place).alias("asks"))

    asked = spots.select(*keys, "start", "end", F.explode(F.array(mark("start", 1, 0, 0), mark("end", 1, 0, 0))).alias("m"))
    none = [F.lit(None).cast(spots.schema[c].dataType).alias(c) for c in ("start", "end")]
    counted = rows.select(*keys, *none, F.explode(F.array(mark("start", 2, 1, 0), mark("end", 0, 0, 1))).alias("m"))
    events = asked.unionByName(counted).select(*keys, "start", "end", "m.*").withColumn("bin", F.floor(F.col("p") / width))
    bins = events.groupBy(*keys, "bin").agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    before = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, -1)
    carry = bins.select(*keys, "bin", F.sum("s").over(before).alias("s_before"), F.sum("e").over(before).alias("e_before"))
    inside = W.partitionBy(*keys, "bin").orderBy("p", "turn").rowsBetween(W.unboundedPreceding, 0)
    seen = events.withColumns({"s_in": F.sum("s").over(inside), "e_in": F.sum("e").over(inside)}).where("turn = 1").join(carry.hint("merge"), [*keys, "bin"], "left")
    sums = {c: F.coalesce(f"{c}_in", F.lit(0)) + F.coalesce(f"{c}_before", F.lit(0)) for c in "se"}
    part = F.when(F.col("asks") == "end", sums["s"]).otherwise(-sums["e"])
    total = seen.groupBy(*keys, "start", "end").agg(F.sum(part).alias(name))
    return total.withColumn(name, F.when(F.col("start") < F.col("end"), F.col(name)).otherwise(F.lit(0)).cast("long"))


def overlap_anti(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """Rows of a that overlap no row of b. Equal places are looked up once, so equal rows stay or go together."""
    place = [*keys, "start", "end"]
    hit = overlap_join(a.select(*place).distinct(), b.select(*place), keys, width)
    hit = hit.select(*keys, F.col("a_start").alias("start"), F.col("a_end").alias("end")).distinct()
    return a.join(hit, place, "left_anti").select(*a.columns)


def nearest_distance(points: DataFrame, b: DataFrame, name: str = "dist", keys: tuple[str, ...] = KEYS, width: int = 1 << 17) -> DataFrame:
    """points (keys, p) with the distance to the nearest row of b, max(0, start - p, p - end); null where b has none.

    Rows meet in bins of p; what lies beyond a bin comes from a carry over bin summaries, a few thousand a chromosome. What
    follows is seen in descending order: Spark sums a frame up to the last row anew for each row, which is quadratic in a bin."""
    spots = points.select(*keys, "p").distinct()
    events = spots.select(*keys, "p", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("e"), F.lit(None).cast("long").alias("s"))
    events = events.unionByName(b.select(*keys, F.col("start").cast("long").alias("p"), F.lit(0).alias("kind"), F.col("end").cast("long").alias("e"), F.col("start").cast("long").alias("s")))
    events = events.withColumn("bin", F.floor(F.col("p") / width))
    bins = events.groupBy(*keys, "bin").agg(F.max("e").alias("e"), F.min("s").alias("s"))
    up, down = (W.partitionBy(*keys).orderBy(o).rowsBetween(W.unboundedPreceding, -1) for o in (F.asc("bin"), F.desc("bin")))
    carry = bins.select(*keys, "bin", F.max("e").over(up).alias("e_before"), F.min("s").over(down).alias("s_after"))
    ahead, back = (W.partitionBy(*keys, "bin").orderBy(*o).rowsBetween(W.unboundedPreceding, 0) for o in (("p", "kind"), (F.desc("p"), F.desc("kind"))))
    near = events.withColumns({"e_in": F.max("e").over(ahead), "s_in": F.min("s").over(back)})
    near = near.where("kind = 1").join(carry.hint("merge"), [*keys, "bin"], "left")
    before = F.greatest("e_in", "e_before")
    after = F.least("s_in", "s_after")
    gap = F.least(F.col("p") - before, after - F.col("p"))
    distance = F.when(before.isNotNull() | after.isNotNull(), F.greatest(F.lit(0), gap))
    return near.select(*keys, "p", distance.cast("long").alias(name))


def pair_anti_2d(neg: DataFrame, pos: DataFrame, keys: tuple[str, ...] = KEYS, width: int = BIN) -> DataFrame:
    """Pairs of neg that no one pair of pos overlaps on both sides."""
    place = [*keys, "x_start", "x_end", "y_start", "y_end"]
    left = binned(neg.select(*place).distinct(), "_bin", width, "x_start", "x_end")
    right = binned(pos.select(*keys, "x_start", "x_end", "y_start", "y_end").distinct(), "_bin", width, "x_start", "x_end")
    right = right.select(*keys, "_bin", *[F.col(c).alias(f"_{c}") for c in ("x_start", "x_end", "y_start", "y_end")])
    both = overlaps(F.col("x_start"), F.col("x_end"), F.col("_x_start"), F.col("_x_end")) & overlaps(F.col("y_start"), F.col("y_end"), F.col("_y_start"), F.col("_y_end"))
    hit = left.hint("merge").join(right, [*keys, "_bin"]).where(both).select(*place).distinct()
    return neg.join(hit, place, "left_anti").select(*neg.columns)


def liftover(runs: DataFrame, chain: DataFrame) -> DataFrame:
    """runs (chr, start, end, value, ...) carried through chain blocks (chr, start, end, to_chr, to_start, strand), cut at
    block edges; on a reverse block places count from its end. Uncovered parts are dropped, as the mapping has none."""
    cut = overlap_segments(runs, chain, ("chr",))
    ahead = F.col("b_to_start") + F.col("start") - F.col("b_start")
    back = F.col("b_to_start") + F.col("b_end") - F.col("end")
    at = F.when(F.col("b_strand") == "-", back).otherwise(ahead)
    other = [F.col(f"a_{c}").alias(c) for c in runs.columns if c not in ("chr", "start", "end")]
    return cut.select(F.col("b_to_chr").alias("chr"), at.alias("start"), (at + F.col("end") - F.col("start")).alias("end"), *other)


def name_segments(segments: DataFrame, cell: Column | str) -> DataFrame:
    """Overlap parts with the name of their anchor: chr:start:end:cell."""
    named = F.concat_ws(":", "chr", "a_start", "a_end", cell)
    return segments.select("chr", "start", "end", named.alias("name"))


def split_name(c: str = "name") -> list[Column]:
    bits = F.split(c, ":")
    return [bits[0].alias("chr"), bits[1].cast("long").alias("start"), bits[2].cast("long").alias("end"), bits[3].alias("cell_type")]
