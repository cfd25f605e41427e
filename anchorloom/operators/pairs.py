"""Anchors, pairs of anchors, and the generators of negative examples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.genomic import CELL, apart, chromosome_rank, windowed
from anchorloom.operators import implicit
from anchorloom.operators.intervals import overlap_anti, pair_anti_2d
from anchorloom.operators.ordering import running_sum
from anchorloom.operators.sampling import sample_exact, sample_fraction
from anchorloom.sources.settled import settled

PAIR = ["chr", "x", "x_start", "x_end", "y", "y_start", "y_end", CELL]
SEED, RATIO, RADIUS, MOST_REGIONS, LONG = 42, 5, 2500, 1000, 1_000_000
MOST_KNOWN, MOST_CELLS = 500_000, 1000
#: Tasks of a quadratic join for each shuffle partition.
SPREAD = 4
MODES = ("anchors_from_other_cell_types", "new_pairs_of_anchors", "open_chromatin_regions", "new_pairs_and_open_chromatin", "FLY_short_loops_as_negatives")


def anchors(pairs: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Distinct (cell_type, chr, center, start, end) of both sides."""
    sides = F.explode(F.array(*[F.struct(F.col(s).alias("center"), F.col(f"{s}_start").alias("start"), F.col(f"{s}_end").alias("end")) for s in "xy"]))
    return pairs.select(CELL, "chr", *(extra or []), sides.alias("a")).select(CELL, "chr", *(extra or []), "a.*").distinct()


def sort_pairs(df: DataFrame, by: str = "x_start", organism: str = "human") -> DataFrame:
    return df.orderBy(chromosome_rank() if organism == "human" else F.col("chr"), by)


def genomic_rank(df: DataFrame, by: str = "x_start", out: str = "rn") -> DataFrame:
    """df with its rank (from 1) in its cell, in order of chromosome and `by`: counts of bins, not a sort of a whole cell."""
    tagged = df.withColumns({"_chr": chromosome_rank(), "_piece": F.floor(F.col(by) / implicit.BIN)})
    return running_sum(tagged, [CELL], ["_chr", "_piece"], [by], F.lit(1).cast("long"), out).drop("_chr", "_piece")


def ordered_pairs(centers: DataFrame, keys: tuple[str, ...] = (CELL, "chr"), radius: int | None = RADIUS, salt: int = 8) -> DataFrame:
    """All (x, y), x < y, of one cell and chromosome; with a radius only where windows do not touch.

    The number of pairs is quadratic by definition; salting the left side spreads a large chromosome over tasks. The
    sides' partitions are numbered outright, as adaptive coalescing goes by their bytes and would leave all to one task."""
    tasks = SPREAD * int(centers.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = centers.select(*keys, F.col("center").alias("x")).distinct().withColumn("_salt", F.pmod(F.xxhash64("x"), F.lit(salt))).repartition(tasks, *keys, "_salt")
    right = centers.select(*keys, F.col("center").alias("y")).distinct().withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)).cast("array<bigint>")))
    met = left.join(right, [*keys, "_salt"]).where(F.col("x") < F.col("y")).drop("_salt")
    return met if radius is None else met.where(apart(radius))


def without_known(candidates: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates that are no positive pair; up to MOST_KNOWN pairs are broadcast, as candidates are quadratic."""
    known = positives.select(CELL, "chr", "x", "y").distinct()
    some = known.limit(MOST_KNOWN + 1).count() <= MOST_KNOWN
    return candidates.join(F.broadcast(known) if some else known, [CELL, "chr", "x", "y"], "left_anti")


def finished(pairs: DataFrame, label: int, radius: int = RADIUS) -> DataFrame:
    """Pairs (cell_type, chr, x, y) with windows and label, in the order and types of the labelled table."""
    out = pairs.withColumns(windowed(radius)).withColumn("label", F.lit(label))
    return typed(out.select(*PAIR, "label"))


def typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in PAIR if c not in ("chr", CELL)} | {"label": F.col("label").cast("short")})


def positives(loops: DataFrame) -> DataFrame:
    return typed(loops.select(*PAIR).distinct().withColumn("label", F.lit(1)))


def _quota(candidates: DataFrame, sizes: DataFrame, strata: list[str], seed: int) -> DataFrame:
    """As many candidates of each stratum as `want` in sizes says; strata not in sizes give none."""
    wanted = candidates.join(sizes, strata)  # broadcast only if its measured size is small
    # The same (x, y) lies on many chromosomes.
    return sample_exact(wanted, [*strata, "x", "y"], seed, F.col("want"), [*strata, "want"], ties=["chr"]).drop("want")


def _cells(loops: DataFrame, ratio: float, keys: list[str]) -> DataFrame:
    want = F.floor(F.count("*") * ratio) if keys == [CELL] else F.bround(F.count("*") * ratio)
    return loops.select(*PAIR).distinct().groupBy(*keys).agg(want.cast("long").alias("want"))


def from_other_cells(loops: DataFrame, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Negatives from half of the other cells' anchors that overlap no anchor of the cell.

    A place meets each cell that does not have it once, however many others do. Cells are read when this is called; more than
    MOST_CELLS fail."""
    own = anchors(loops)
    cells = [r[0] for r in own.select(CELL).distinct().limit(MOST_CELLS + 1).collect()]
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    places = own.groupBy("chr", "center", "start", "end").agg(F.collect_set(CELL).alias("_own"))  # at most MOST_CELLS values
    lacking = F.array_except(F.array(*map(F.lit, cells)).cast("array<string>"), "_own")
    others = places.select(F.explode(lacking).alias(CELL), "chr", "center", "start", "end")
    free = overlap_anti(others, own.select(CELL, "chr", "start", "end"))
    half = sample_fraction(free, [CELL, "chr", "center"], seed, 0.5, [CELL])
    return finished(implicit.sample(half, _cells(loops, ratio, [CELL]), [CELL], seed, radius), 0, radius)


def from_new_pairs(loops: DataFrame, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS, sizes: DataFrame | None = None) -> DataFrame:
    """Negatives from pairs of the cell's anchors that are no loop."""
    sizes = _cells(loops, ratio, [CELL]) if sizes is None else sizes
    return finished(implicit.sample(anchors(loops), sizes, [CELL], seed, radius, loops), 0, radius)


def from_open_regions(loops: DataFrame, peaks: DataFrame, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS, most: int = MOST_REGIONS) -> DataFrame:
    """Negatives from pairs of at most `most` open regions a chromosome."""
    centers = peaks.select(CELL, "chr", F.floor((F.col("start") + F.col("end")) / 2).cast("long").alias("center"), "start", "end")
    centers = centers.join(loops.select(CELL, "chr").distinct(), [CELL, "chr"], "left_semi")
    capped = sample_exact(centers, [CELL, "chr", "start", "end"], seed, most, [CELL, "chr"])
    return finished(implicit.sample(capped, _cells(loops, ratio, [CELL, "chr"]), [CELL, "chr"], seed, radius), 0, radius)


def from_both(loops: DataFrame, peaks: DataFrame, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """Half the ratio from open regions, then half from new pairs of the anchors of loops and of those negatives."""
    first = settled(from_open_regions(loops, peaks, ratio / 2, seed, radius))  # read several times below
    combined = loops.select(*PAIR).unionByName(first.select(*PAIR)).distinct()
    sizes = combined.groupBy(CELL).agg(F.floor(F.count("*") * ratio / 2).cast("long").alias("want"))
    return first.unionByName(from_new_pairs(combined, ratio / 2, seed, radius, sizes))


def short_loops(loops: DataFrame, limit: int = LONG) -> DataFrame:
    """Loops labelled 1 if longer than limit, else 0, without short ones that a long one overlaps on both sides."""
    labelled = typed(loops.select(*PAIR).distinct().withColumn("label", (F.col("y") - F.col("x") > limit).cast("int")))
    return remove_overlapping(labelled)


def remove_overlapping(labelled: DataFrame) -> DataFrame:
    """Drop negatives that one positive overlaps on both sides, and rows with nulls."""
    return remove_overlapping_reported(labelled)[0]


def remove_overlapping_reported(labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """remove_overlapping() and the report of the rows that go for their nulls (features.drop_nulls)."""
    from anchorloom.operators.features import drop_nulls

    pos, neg = labelled.where("label = 1"), labelled.where("label = 0")
    return drop_nulls(pos.unionByName(pair_anti_2d(neg, pos)))


def add_labels(loops: DataFrame, mode: str, peaks: DataFrame | None = None, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS, limit: int = LONG) -> DataFrame:
    """Labelled pairs of every cell by one of MODES."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}")
    if mode == MODES[4]:
        return short_loops(loops, limit)
    if mode in MODES[2:4] and peaks is None:
        raise ValueError(f"{mode} needs peaks")
    made = {MODES[0]: lambda: from_other_cells(loops, ratio, seed, radius), MODES[1]: lambda: from_new_pairs(loops, ratio, seed, radius), MODES[2]: lambda: from_open_regions(loops, peaks, ratio, seed, radius), MODES[3]: lambda: from_both(loops, peaks, ratio, seed, radius)}[mode]()
    return positives(loops).unionByName(made)


def drop_shared_anchors(labelled: DataFrame) -> DataFrame:
    """Negatives that share x with a positive go, then those that share y with one."""
    pos, neg = labelled.where("label = 1"), labelled.where("label = 0")
    for s in "xy":
        neg = neg.join(pos.select(CELL, "chr", s).distinct(), [CELL, "chr", s], "left_anti")
    return pos.unionByName(neg.select(*pos.columns))


def random_negatives(labelled: DataFrame, seed: int = SEED) -> DataFrame:
    """All positives and as many negatives, cell by cell."""
    pos = labelled.where("label = 1")
    return pos.unionByName(_quota(labelled.where("label = 0"), pos.groupBy(CELL).agg(F.count("*").alias("want")), [CELL], seed).select(*pos.columns))


def random_pairing(labelled: DataFrame, ratio: float = RATIO, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """New pairs of the negatives' centres, ratio for each positive."""
    centers = anchors(labelled.where("label = 0"))
    sizes = labelled.where("label = 1").groupBy(CELL).agg(F.floor(F.count("*") * ratio).cast("long").alias("want"))
    return finished(implicit.sample(centers, sizes, [CELL], seed, radius), 0, radius)
