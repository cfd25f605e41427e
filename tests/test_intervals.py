"""Hand-computed cases and random intervals against plain loops."""

import random

import pytest

from anchorloom.operators import intervals, pairs


def table(spark, rows, extra=""):
    return spark.createDataFrame([("A", "1", *r) for r in rows], f"cell_type string, chr string, start long, end long{extra}")


def counts(spark, a, b):
    return {(r.start, r.end): r.cnt for r in intervals.overlap_count(table(spark, a), table(spark, b)).collect()}


def test_overlap_is_half_open_and_zero_is_kept(spark):
    assert counts(spark, [(10, 20)], [(20, 30)]) == {(10, 20): 0}
    assert counts(spark, [(10, 20)], [(19, 30)]) == {(10, 20): 1}
    segment = intervals.overlap_segments(table(spark, [(10, 20)]), table(spark, [(19, 30)])).first()
    assert (segment.start, segment.end) == (19, 20)


def test_random_intervals(spark):
    rng = random.Random(1)
    make = lambda n, far: [(s := rng.randrange(100_000), s + rng.randrange(1, far)) for _ in range(n)]
    a, b = make(60, 30_000), make(80, 20_000)
    want = {x: sum(x[0] < y[1] and y[0] < x[1] for y in b) for x in a}
    assert counts(spark, a, b) == want
    joined = intervals.overlap_join(table(spark, a), table(spark, b)).collect()
    assert len(joined) == sum(want.values())
    free = {(r.start, r.end) for r in intervals.overlap_anti(table(spark, a), table(spark, b[:3])).collect()}
    assert free == {x for x in a if not any(x[0] < y[1] and y[0] < x[1] for y in b[:3])}
    points = [rng.randrange(130_000) for _ in range(50)]
    got = {r.p: r.dist for r in intervals.nearest_distance(spark.createDataFrame([("A", "1", p) for p in points], "cell_type string, chr string, p long"), table(spark, b), width=4096).collect()}
    assert got == {p: min(max(0, s - p, p - e) for s, e in b) for p in points}


@pytest.mark.parametrize(("p", "peaks", "want"), [(15, [(10, 20)], 0), (15, [(1, 5), (30, 40)], 10)])
def test_nearest(spark, p, peaks, want):
    point = spark.createDataFrame([("A", "1", p), ("A", "2", p)], "cell_type string, chr string, p long")
    got = {r.chr: r.dist for r in intervals.nearest_distance(point, table(spark, peaks)).collect()}
    assert got == {"1": want, "2": None}  # without peaks: null, never 0


def pair(x, y, label, r=5):
    return ("A", "1", x, x - r, x + r, y, y - r, y + r, label)


PAIR = "cell_type string, chr string, x long, x_start long, x_end long, y long, y_start long, y_end long, label int"


def test_both_sides_must_meet_the_same_positive(spark):
    apart = spark.createDataFrame([pair(100, 900, 1), pair(300, 500, 1), pair(100, 500, 0)], PAIR)
    assert pairs.remove_overlapping(apart).where("label = 0").count() == 1
    same = spark.createDataFrame([pair(100, 500, 1), pair(103, 504, 0)], PAIR)
    assert pairs.remove_overlapping(same).where("label = 0").count() == 0


def test_label_and_window_are_strict(spark):
    loops = spark.createDataFrame([pair(0, 1_000_000, 0)[:-1], pair(0, 1_000_001, 0)[:-1]], PAIR.rpartition(",")[0])
    got = {r.y: r.label for r in pairs.short_loops(loops).collect()}
    assert got == {1_000_001: 1}  # the short one overlaps the long one
    centers = spark.createDataFrame([("A", "1", 0), ("A", "1", 5000), ("A", "1", 5001)], "cell_type string, chr string, center long")
    assert {(r.x, r.y) for r in pairs.ordered_pairs(centers).collect()} == {(0, 5001)}


def test_modes(spark):
    loops = spark.createDataFrame([pair(0, 9000, 0)[:-1]], PAIR.rpartition(",")[0])
    with pytest.raises(ValueError, match="mode"):
        pairs.add_labels(loops, "other")
    with pytest.raises(ValueError, match="peaks"):
        pairs.add_labels(loops, pairs.MODES[2])
    chain = spark.createDataFrame([("1", 100, 200, "2", 1000, "-")], "chr string, start long, end long, to_chr string, to_start long, strand string")
    runs = spark.createDataFrame([("1", 90, 110, 2.5)], "chr string, start long, end long, value double")
    assert [tuple(r) for r in intervals.liftover(runs, chain).collect()] == [("2", 1090, 1100, 2.5)]


def test_counts_with_edges_that_meet_bins_and_nulls(spark):
    rng = random.Random(5)
    # Places that coincide, bins that hold spots only, empty intervals and rows of another chromosome.
    a = [(s := 10 * rng.randrange(40), s + 10 * rng.randrange(0, 12)) for _ in range(80)]
    b = [(s := 10 * rng.randrange(40), s + 10 * rng.randrange(0, 12)) for _ in range(200)]
    kind = "cell_type string, chr string, start long, end long"
    spots = spark.createDataFrame([("A", "1", *x) for x in a] + [("A", "2", 5, 9), (None, "1", 5, 9), ("A", "1", None, 9)], kind)
    other = spark.createDataFrame([("A", "1", *x) for x in b] + [(None, "1", 0, 100)], kind)
    got = {(r.cell_type, r.chr, r.start, r.end): r.cnt for r in intervals.overlap_count(spots, other, width=64).collect()}
    want = {("A", "1", *x): sum(y[0] < y[1] and x[0] < x[1] and x[0] < y[1] and y[0] < x[1] for y in b) for x in a}
    assert got == want | {("A", "2", 5, 9): 0, (None, "1", 5, 9): 0, ("A", "1", None, 9): 0}


def test_anti_keeps_equal_rows_and_nulls(spark):
    kind = "cell_type string, chr string, start long, end long, name string"
    a = spark.createDataFrame([("A", "1", 0, 10, "x"), ("A", "1", 0, 10, None), ("A", "1", 20, 30, "y"), ("A", "1", 20, 30, "y"), (None, "1", 0, 10, "z")], kind)
    got = intervals.overlap_anti(a, table(spark, [(5, 6)]))
    assert got.columns == a.columns
    assert sorted(r.name for r in got.collect()) == ["y", "y", "z"]
