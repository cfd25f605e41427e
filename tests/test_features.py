import numpy as np
import pytest
from pyspark.sql import functions as F

from anchorloom.functions.genomic import chromosome_rank, middle_even, middle_floor
from anchorloom.operators import evaluation, features, motifs, sampling, signal


def test_midpoints_and_order(spark):
    df = spark.createDataFrame([(1, 4), (3, 4)], "a long, b long")
    assert [r[0] for r in df.select(middle_even("a", "b")).collect()] == [2, 4]
    assert [r[0] for r in df.select(middle_floor("a", "b")).collect()] == [2, 3]
    names = spark.createDataFrame([("10",), ("2",), ("Y",), ("X",), ("M",)], "chr string").orderBy(chromosome_rank())
    assert [r.chr for r in names.collect()] == ["2", "10", "X", "Y", "M"]


def test_kernel(spark):
    k = lambda n: [r[0] for r in spark.range(1, n + 1).select(signal.kernel(F.col("id"), F.lit(n)) - signal.kernel(F.col("id") - 1, F.lit(n))).collect()]
    assert k(4) == [1, 2, 2, 1] and k(5) == [1, 2, 3, 2, 1]


def test_signal_against_one_value_a_base(spark):
    rng = np.random.default_rng(0)
    runs, at = [], 0
    while at < 4000:
        at += int(rng.integers(0, 60))
        n = int(rng.integers(1, 90))
        runs.append(("A", "1", at, at + n, float(rng.integers(-9, 99))))
        at += n
    dense = np.zeros(6000)
    for *_, a, b, v in runs:
        dense[a:b] = v
    spots = [("A", "1", s, s + 200) for s in (0, 33, 400, 1717, 3950, 5500)]
    got = signal.signal_stats(spark.createDataFrame(spots, "cell_type string, chr string, start long, end long"), spark.createDataFrame(runs, "cell_type string, chr string, start long, end long, value double")).collect()
    weights = np.minimum(np.arange(1, 201), 200 - np.arange(200))
    assert len(got) == len(spots)
    for r in got:
        x = dense[r.start : r.end]
        blocks = x.reshape(-1, 20).mean(1)
        assert np.allclose([r["mean"], r.weighted_mean, r["min"], r["max"]], [x.mean(), x @ weights / weights.sum(), blocks.min(), blocks.max()])


def test_motif_scan_and_threshold(spark):
    w = motifs.weights(np.array([[9, 0, 0], [0, 9, 0], [0, 0, 9], [0, 0, 0]]))
    hits = motifs.scan(spark.createDataFrame([("s", "ACGTNCGT"), ("t", None), ("u", "AC")], "name string, seq string"), {"m": w}, {"m": int(w.max(0).sum())})
    assert sorted((r.name, r.strand, r.pos) for r in hits.collect()) == [("s", "+", 0), ("s", "-", 1), ("s", "-", 5)]
    rng = np.random.default_rng(1)
    long = motifs.weights(rng.integers(0, 20, (4, 6)))
    every = np.array(np.meshgrid(*[range(4)] * 6)).reshape(6, -1)
    score = sum(long[every[k], k] for k in range(6))
    cut = motifs.threshold(long, 0.01)
    assert (score >= cut).mean() < 0.01 <= (score >= cut - 1).mean()


def test_motif_merge_quirks(spark):
    pairs = spark.createDataFrame([("A", "1", 0, 10, 50, 60), ("A", "1", 0, 10, 90, 99)], "cell_type string, chr string, x_start long, x_end long, y_start long, y_end long")
    counts = spark.createDataFrame([("A", "1", 0, 10, 5, 6), ("A", "1", 50, 60, 2, 1)], "cell_type string, chr string, start long, end long, `MA.1_f` long, `MA.1_r` long")
    got = {r.y_start: [r["x_MA.1_f"], r["x_MA.1_r"], r["y_MA.1_f"], r["y_MA.1_r"]] for r in motifs.motif_merge(pairs, counts, ["MA.1"]).collect()}
    assert got == {50: [5, 6, 1, 2], 90: [0, 0, 0, 0]}
    loose = {r.y_start: r["x_MA.1_f"] for r in motifs.motif_merge(pairs, counts, ["MA.1"], strict=False).collect()}
    assert loose == {50: 5, 90: 5}


def test_samples_are_exact_and_repeat(spark):
    df = spark.range(1000).withColumn("g", F.col("id") % 3)
    one = sampling.sample_exact(df, ["id"], 1, 17, ["g"])
    assert {r.g: r["count"] for r in one.groupBy("g").count().collect()} == {0: 17, 1: 17, 2: 17}
    assert set(one.collect()) == set(sampling.sample_exact(df, ["id"], 1, 17, ["g"]).collect())
    assert sampling.sample_exact(df, ["id"], 1, 5000).count() == 1000 and sampling.sample_fraction(df, ["id"], 1, 0.5).count() == 500
    split = sampling.train_test(df, ["id"], 1, 0.3, ["g"]).groupBy("g", "split").count().collect()
    assert sum(r["count"] for r in split if r.split == "test") == 300
    assert {r["count"] for r in sampling.folds(df, ["id"], 1, 10, ["g"]).groupBy("fold").count().collect()} <= set(range(97, 104))


def test_metrics(spark):
    rows = [("g", 1, 1)] * 8 + [("g", 1, 0)] * 2 + [("g", 0, 0)] * 6 + [("g", 0, 1)] * 4 + [("h", 0, 0)]
    got = {r.grp: r for r in evaluation.binary_metrics(spark.createDataFrame(rows, "grp string, label int, pred int")).collect()}
    assert got["g"].roc_auc == pytest.approx(0.7) and got["g"].accuracy == pytest.approx(0.7) and got["h"].precision == 0


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 0, "A")], "a int, b int, label int, cell_type string")
    assert features.select_features(df, ["a"]).columns == ["a", "label", "cell_type"]
    assert features.select_features(df, exclude=["b"]).columns == ["a", "label", "cell_type"]
    with pytest.raises(ValueError, match="columns"):
        features.select_features(df, ["z"])
    with pytest.raises(ValueError, match="cells"):
        features.concat_aligned([df], ["A", "B"])


def test_slices_meet_chunks_not_chromosomes(spark):
    rng = np.random.default_rng(2)
    genome = {"chr1": "".join(rng.choice(list("ACGT"), 103)), "chr2": "ACGTA", "chr3": "", "chr4": None}
    parts = [("chr1", int(s), int(s + n), f"p{i}") for i, (s, n) in enumerate(zip(rng.integers(0, 103, 60), rng.integers(0, 25, 60), strict=True))]
    parts += [parts[0], ("chr1", 9, 10, "edge"), ("chr1", 95, 140, "past"), ("chr2", 0, 5, "all"), ("chr3", 0, 4, "none"), ("chr4", 0, 4, "null"), ("chr9", 0, 4, "unknown")]
    texts = spark.createDataFrame(list(genome.items()), "chr string, seq string")
    for width in (10, 1000):  # the longest part is 45: wider than a chunk of 10
        got = sorted((r.name, r.seq) for r in motifs.slices(spark.createDataFrame(parts, "chr string, start long, end long, name string"), texts, width).collect() if r.name != "null")
        assert got == sorted((n, genome[c][s:e]) for c, s, e, n in parts if genome.get(c) is not None)
    cut = sorted((r.chunk, r.seq) for r in motifs.chunks(texts.where("chr = 'chr2'"), 1, 2).collect())
    assert cut == [(0, "ACG"), (1, "GTA"), (2, "A")]


def test_scan_across_stretches(spark):
    rng = np.random.default_rng(4)
    rows = [(str(i), "".join(rng.choice(list("ACGTN"), n))) for i, n in enumerate((0, 1, 40, 700, 3, 55))]
    w = motifs.weights(rng.integers(0, 9, (4, 5)))
    sequences = spark.createDataFrame(rows, "name string, seq string")
    whole = {tuple(r) for r in motifs.scan(sequences, {"m": w}, {"m": 200}).collect()}
    before, motifs.STRETCH = motifs.STRETCH, 7
    try:
        assert whole == {tuple(r) for r in motifs.scan(sequences, {"m": w}, {"m": 200}).collect()}
    finally:
        motifs.STRETCH = before
    want = {(n, "m", strand, p, s) for n, seq in rows for strand, m in (("+", w), ("-", w[::-1, ::-1])) for p in range(len(seq) - 4) if "N" not in seq[p : p + 5] and (s := int(sum(m["ACGT".index(seq[p + k]), k] for k in range(5)))) >= 200}
    assert want and whole == want


def test_tracks_wide_levels(spark):
    stats = spark.createDataFrame([("A", "1", 0, 10, t, m, m, m, m) for t, m in (("t", 2.0), ("u", 5.0))] + [("A", "1", 50, 60, "t", 6.0, 6.0, 1.0, 9.0)], "cell_type string, chr string, start long, end long, track string, mean double, weighted_mean double, min double, max double")
    pairs = spark.createDataFrame([("A", "1", 0, 10, 50, 60)], "cell_type string, chr string, x_start long, x_end long, y_start long, y_end long")
    r = signal.tracks_wide(pairs, stats, ["t", "u"]).first()
    assert (r.x_t_mean, r.y_t_max, r.x_u_mean, r.y_u_mean) == (0.5, 2.25, 1.0, None)


def test_nulls_are_reported_and_keys_checked(spark):
    df = spark.createDataFrame([(1, None), (2, 3), (None, None)], "a long, `b.c` long")
    clean, report = features.drop_nulls(df)
    assert [tuple(r) for r in clean.collect()] == [(2, 3)]
    assert report.first().asDict() == {"_rows": 3, "_dropped": 2, "a": 1, "b.c": 2}
    features.check_same_keys(df, df.limit(3), ["a"])
    with pytest.raises(ValueError, match="only one table"):
        features.check_same_keys(df, df.where("a = 2"), ["a"])
    labelled = spark.createDataFrame([("A", 1, 2)], "cell_type string, label int, x long")
    with pytest.raises(ValueError, match="cannot be excluded"):
        features.select_features(labelled, exclude=["label"])
