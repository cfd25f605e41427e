"""Samples of pairs of centres that are numbered, not made.

Along a chromosome's sorted centres, the partners of x are the centres from one place on to the last: how many there are
follows from ranks alone. Prefix sums of these counts number all pairs of a stratum, 0 to n - 1, in order of chromosome, x
and y. A keyed permutation of these numbers is read from its start, each number drawn is looked up (its x by the prefix sums,
its y by its rank), pairs known already are left out, and the first `want` of a stratum stay. Work and shuffles grow with
centres and pairs drawn, never with the number of pairs. Numbers come from a few rows that are exploded, and tables from
small files: estimates take both for small, so joins with them are merges by hint and nothing of them reaches the driver.

The permutation acts on a square of side floor(sqrt(n)) + 1, row and column being mixed in turn (a Feistel network); its few numbers
from n on are skipped. As many numbers are read as suffice in any case: want, known pairs and those few. So a sample is
exact in size, without replacement and without redrawing, and it is the same on every run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL
from anchorloom.operators.ordering import running_sum
from anchorloom.sources.settled import settled

ROUNDS = 4
#: Width of the bins along a chromosome, and numbers that are drawn in a row.
BIN, BLOCK = 1 << 20, 10_000


def partners(centers: DataFrame, radius: int | None) -> DataFrame:
    """(cell_type, chr, x, rank, first, last) of each distinct centre: y may be those of ranks first to last - 1.

    y lies right of x, and with a radius the windows around both do not touch. Ranks count from 0 along the chromosome."""
    distinct = centers.select(CELL, "chr", F.col("center").cast("long").alias("x")).distinct()
    reach = 2 * radius if radius else 0
    kinds = F.explode(F.array(F.struct(F.col("x").alias("at"), F.lit(0).alias("kind")), F.struct((F.col("x") + reach).alias("at"), F.lit(1).alias("kind"))))
    events = distinct.select("*", kinds.alias("e")).select(CELL, "chr", "x", "e.*").withColumn("bin", F.floor(F.col("at") / BIN))
    # Centres up to a place: for x itself its rank and one more, for the end of its reach the first partner's rank.
    counted = running_sum(events, [CELL, "chr"], ["bin"], ["at", "kind"], (F.col("kind") == 0).cast("long"), "through")
    sizes = distinct.groupBy(CELL, "chr").agg(F.count("*").alias("last"))
    at = lambda k: F.max(F.when(F.col("kind") == k, F.col("through")))
    return counted.groupBy(CELL, "chr", "x").agg((at(0) - 1).alias("rank"), at(1).alias("first")).join(sizes, [CELL, "chr"])


def numbered(ranked: DataFrame, strata: list[str]) -> DataFrame:
    """partners() that have any, with base, the number of their first pair, in order of chromosome and x in each stratum."""
    some = ranked.where("first < last").withColumns({"many": F.col("last") - F.col("first"), "bin": F.floor(F.col("x") / BIN)})
    bins = [c for c in ("chr", "bin") if c not in strata]
    return running_sum(some, strata, bins, ["x"], F.col("many"), "through").withColumn("base", F.col("through") - F.col("many")).drop("through", "bin")


def _drawn(sizes: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """(strata, block, k, number, want, width) of the numbers to look up; sizes: (strata, n, want, known, width), few rows."""
    tasks = int(sizes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = (F.floor(F.sqrt(F.col("n").cast("double"))) + 1).cast("long")
    sized = sizes.where("n > 0 and want > 0").withColumn("side", side)
    most = F.least(F.col("side") * F.col("side"), F.col("want") + F.col("known") + F.col("side") * F.col("side") - F.col("n"))
    blocks = sized.withColumn("most", most).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("most") - 1) / BLOCK))))
    end = F.least(F.col("most"), (F.col("block") + 1) * BLOCK) - 1
    each = blocks.repartition(tasks, *strata, "block").withColumn("k", F.explode(F.sequence(F.col("block") * BLOCK, end)))
    key = F.concat_ws("|", F.lit(str(seed)), F.concat_ws(",", *strata))

    def turn(halves: Column, r: Column) -> Column:
        word = F.md5(F.concat_ws("|", key, r.cast("string"), halves["right"].cast("string")))
        return F.struct(halves["right"].alias("left"), F.pmod(halves["left"] + F.conv(F.substring(word, 1, 8), 16, 10).cast("long"), F.col("side")).alias("right"))

    # A fold: as nested columns, the rounds would be written out again wherever the number is used.
    start = F.struct(F.floor(F.col("k") / F.col("side")).cast("long").alias("left"), F.pmod("k", "side").alias("right"))
    number = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, turn, lambda halves: halves["left"] * F.col("side") + halves["right"])
    return each.withColumn("number", number).where("number < n").select(*strata, "block", "k", "number", "want", "width")


def _looked_up(drawn: DataFrame, sizes: DataFrame, pairs: DataFrame, ranked: DataFrame, strata: list[str]) -> DataFrame:
    """drawn with chr, x and y of its number. Numbers and the ranges of x meet in cells of `width`, about as many as there are x."""
    cell = lambda c: F.floor(F.col(c) / F.col("width"))
    ranges = pairs.join(sizes.select(*strata, "width"), strata).withColumn("_end", F.col("base") + F.col("many") - 1).withColumn("_cell", F.explode(F.sequence(cell("base"), cell("_end"))))
    ranges = ranges.select(*strata, *[c for c in ("chr",) if c not in strata], "x", "first", "base", "_end", "_cell")
    met = drawn.withColumn("_cell", cell("number")).hint("merge").join(ranges, [*strata, "_cell"]).where("number between base and _end")
    placed = met.withColumn("rank", F.col("first") + F.col("number") - F.col("base")).select(*drawn.columns, *[c for c in ("chr",) if c not in strata], "x", "rank")
    return placed.hint("merge").join(ranked.select(CELL, "chr", "rank", F.col("x").alias("y")), [CELL, "chr", "rank"]).drop("rank")


def sample(centers: DataFrame, sizes: DataFrame, strata: list[str], seed: int, radius: int | None, known: DataFrame | None = None) -> DataFrame:
    """want pairs (cell_type, chr, x, y) of each stratum (the cell, or cell and chromosome), none of which is in known.

    sizes: (strata, want), few rows; strata that it lacks give none, those with too few pairs give all. Ranks, numbers and
    what is drawn are settled when this is called: a row for each centre or pair drawn."""
    ranked = settled(partners(centers, radius))
    pairs = settled(numbered(ranked, strata))
    width = F.greatest(F.floor(F.sum("many") / F.count("*")), F.lit(1)).cast("long")
    whole = pairs.groupBy(*strata).agg(F.sum("many").alias("n"), width.alias("width")).join(sizes.select(*strata, "want"), strata)
    if known is None:
        whole = whole.withColumn("known", F.lit(0).cast("long"))
    else:
        known = known.select(CELL, "chr", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).distinct()
        whole = whole.join(known.groupBy(*strata).agg(F.count("*").alias("known")), strata, "left").fillna(0, ["known"])
    whole = settled(whole)
    found = _looked_up(_drawn(whole, strata, seed), whole, pairs, ranked, strata)
    if known is not None:
        found = found.hint("merge").join(known, [CELL, "chr", "x", "y"], "left_anti")
    first = running_sum(settled(found), strata, ["block"], ["k"], F.lit(1).cast("long"), "place")
    return first.where("place <= want").select(CELL, "chr", "x", "y")
