import pytest
from pyspark.sql import functions as F

from anchorloom.ml import experiment, training
from anchorloom.ml.search import Range
from anchorloom.operators import evaluation, pairs, sampling, signal


@pytest.fixture(scope="module")
def table(spark):
    cell = F.when(F.col("id") % 3 == 0, "A").when(F.col("id") % 3 == 1, "B").otherwise("C")
    return spark.range(360).select("id", cell.alias("cell_type"), (F.col("id") % 7).alias("f"), (F.col("id") % 11).alias("noise"), (F.col("id") % 7 > 3).cast("int").alias("label"))


def test_within_judges_test_rows_of_each_cell(spark, table):
    out = experiment.within_cells(table, "decision_tree", ["id"], test=0.25)
    want = sampling.train_test(table, ["id"], training.SEED, 0.25, ["cell_type", "label"]).where("split = 'test'").groupBy("cell_type").count().collect()
    assert {r.grp: r["count"] for r in out.predictions.groupBy("grp").count().collect()} == {r.cell_type: r["count"] for r in want}
    assert all(r.f1 == 1 for r in out.metrics.collect()) and {r.grp for r in out.metrics.collect()} == {"A", "B", "C"}
    top = {}
    for r in out.importances.collect():
        top.setdefault(r.grp, r.feature)
    assert top == dict.fromkeys("ABC", "f") and set(out.seconds) == {"search", "train_and_judge"}


def test_parts_are_exact_and_disjoint(table):
    parts = experiment._parts(table, ["id"], 0.2, 0.3).collect()
    assert len({r.id for r in parts}) == len(parts) == 360
    got = {p: sum(r.part == p for r in parts) for p in ("fit", "check", "test")}
    want = {"test": 0, "check": 0}
    for n in (r["count"] for r in table.groupBy("cell_type", "label").count().collect()):
        test = round(n * 0.2)
        want["test"] += test
        want["check"] += round((n - test) * 0.3 / 0.8)
    assert {k: got[k] for k in want} == want


def test_across_never_learns_from_the_cell(spark, table):
    turned = table.withColumn("label", F.when(F.col("cell_type") == "C", 1 - F.col("label")).otherwise(F.col("label")))
    got = {r.grp: r.accuracy for r in experiment.across_cells(turned, "decision_tree", ["id"]).metrics.collect()}
    assert got["C"] == 0  # the others say the opposite
    with pytest.raises(ValueError, match="learn from for"):
        experiment.across_cells(table.where("cell_type = 'A'"), "decision_tree", ["id"])
    with pytest.raises(ValueError, match="learn from"):
        experiment.within_cells(table.limit(0), "decision_tree", ["id"])
    with pytest.raises(ValueError, match="learn from"):
        experiment.by_folds(table.limit(0), "decision_tree", ["id"])


def test_nulls_repeats_and_other_columns(spark, table):
    lacking = table.withColumn("f", F.when(F.col("id") == 5, None).otherwise(F.col("f"))).withColumn("label", F.when(F.col("id") == 6, None).otherwise(F.col("label")))
    lacking = lacking.withColumn("cell_type", F.when(F.col("id") == 7, None).otherwise(F.col("cell_type"))).withColumns({"text": F.lit("x"), "split": F.lit(1), "part": F.lit("p")})
    out = experiment.by_folds(lacking.unionByName(lacking.where("id in (5, 8)")), "decision_tree", ["id"], 3)
    assert out.predictions.count() == 358  # three rows lack something, one is there twice


def test_settings_are_searched_saved_and_used(spark, table, tmp_path):
    saved, runs = str(tmp_path / "best.json"), str(tmp_path / "runs")
    tuning = experiment.Tuning(trials=2, space={"max_depth": Range(1, 2, 1, True)})
    out = experiment.within_cells(table, "decision_tree", ["id"], tuning=tuning, saved=saved, runs=(runs, "one"))
    again = experiment.within_cells(table, "decision_tree", ["id"], saved=saved)
    assert out.settings == again.settings and set(out.settings) == {"A", "B", "C"}
    logged = {r.metric: r.value for r in spark.read.parquet(runs).collect()}
    assert {"seconds/search", "seconds/train_and_judge"} <= set(logged) and all(f"{c}/{m}" in logged for c in "ABC" for m in evaluation.METRICS)
    flat = experiment.within_cells(table, "decision_tree", ["id"], settings={"A": {"max_depth": 0}})
    assert flat.models["A"].stages[-1].depth == 0 and flat.models["B"].stages[-1].depth > 0
    folds = experiment.by_folds(table, "decision_tree", ["id"], 3, tuning=tuning, saved=saved)
    assert folds.settings["all"] == experiment.by_folds(table, "decision_tree", ["id"], 3, saved=saved).settings["all"]


def test_a_worse_setting_is_not_taken(table):
    data = experiment._parts(table, ["id"], 0.2, 0.3).where("cell_type = 'A'")
    poor = experiment.Tuning(trials=2, space={"max_depth": [0]})
    assert experiment._best(data, "decision_tree", ["f", "noise"], poor) == {}
    least = experiment.Tuning(trials=2, space={"max_depth": [0]}, metric="accuracy", maximise=False)
    assert experiment._best(data, "decision_tree", ["f", "noise"], least) == {"max_depth": 0}


def test_folds_and_written_tables(spark, table, tmp_path):
    out = experiment.by_folds(table, "logistic_regression", ["id"], 4)
    assert out.predictions.count() == 360 and set(out.models) == {"all"}
    experiment.write(out, str(tmp_path / "run"))
    assert spark.read.parquet(str(tmp_path / "run/predictions")).count() == 360
    points = experiment.read_curve(spark, str(tmp_path / "run")).collect()
    assert points[-1].tpr == points[-1].fpr == 1 and all(a.tpr <= b.tpr for a, b in zip(points, points[1:]))
    assert spark.read.csv(str(tmp_path / "run/importances"), sep="\t", header=True).first().feature == "f"
    from pyspark.ml import PipelineModel

    assert PipelineModel.load(str(tmp_path / "run/models/all")).stages[-1].coefficients == out.models["all"].stages[-1].coefficients


def test_tracks_are_bounded(spark, monkeypatch):
    spots = spark.createDataFrame([("A", "1", 0, 40)], "cell_type string, chr string, start long, end long")
    runs = spark.createDataFrame([("A", "1", 0, 20, 3.0, t) for t in ("t", None)], "cell_type string, chr string, start long, end long, value double, track string")
    got = {r.track: r["mean"] for r in signal.signal_stats(spots, runs.where("track is not null"), extra=("track",)).collect()}
    assert got == {"t": 1.5} and signal.signal_stats(spots, runs.limit(0), extra=("track",)).count() == 0
    monkeypatch.setattr(signal, "MOST_TRACKS", 1)
    with pytest.raises(ValueError, match="tracks"):
        signal.signal_stats(spots, runs, extra=("track",))


def test_places_of_other_cells_meet_each_cell_once(spark, monkeypatch):
    rows = [(c, "1", x, x - 2500, x + 2500, y, y - 2500, y + 2500) for c, x, y in (("A", 10_000, 50_000), ("B", 90_000, 130_000), ("B", 170_000, 210_000), ("C", 90_000, 170_000), ("C", 250_000, 290_000))]
    loops = spark.createDataFrame(rows, "cell_type string, chr string, x long, x_start long, x_end long, y long, y_start long, y_end long")
    made = pairs.from_other_cells(loops, ratio=2)
    own = {c: {r[2] for r in rows if r[0] == c} | {r[5] for r in rows if r[0] == c} for c in "ABC"}
    for r in made.collect():
        rest = set().union(*(own[c] for c in own if c != r.cell_type))
        assert {r.x, r.y} <= rest - own[r.cell_type]
    assert made.count() == made.distinct().count() > 0
    monkeypatch.setattr(pairs, "MOST_CELLS", 2)
    with pytest.raises(ValueError, match="cells"):
        pairs.from_other_cells(loops)


def test_rows_that_go_for_nulls_are_reported(spark):
    rows = [("1", 10, 0, 20, 60, 50, 70, "A", 1, 1.0), ("1", 12, 2, 22, 62, 52, 72, "A", 0, 1.0), ("1", 110, 100, 120, 160, 150, 170, "A", 0, float("nan")), ("1", 210, 200, 220, 260, 250, 270, "A", 0, None), ("1", 310, 300, 320, 360, 350, 370, "A", 0, 2.0)]
    df = spark.createDataFrame(rows, "chr string, x long, x_start long, x_end long, y long, y_start long, y_end long, cell_type string, label int, v double")
    clean, report = pairs.remove_overlapping_reported(df)
    assert sorted(r.x for r in clean.collect()) == sorted(r.x for r in pairs.remove_overlapping(df).collect()) == [10, 310]
    assert (report.first()["_rows"], report.first()["_dropped"], report.first()["v"]) == (4, 2, 2)


def test_inputs_are_made_once(spark, table):
    made = spark.sparkContext.accumulator(0)

    def f(x):
        made.add(1)
        return x

    slow = table.withColumn("f", F.udf(f, "long").asNondeterministic()("f"))
    for run in (experiment.within_cells, experiment.across_cells, experiment.by_folds):
        before = made.value
        run(slow, "decision_tree", ["id"])
        assert made.value - before == 360, run.__name__


def test_marks_are_counted_over_runs(spark, tmp_path):
    from anchorloom.plans import catalog

    texts = ["", "*", "a*#b\n$%\r\n&|!", "\U0001f600*é**", "no marks\n", None]
    spark.createDataFrame([(i, "en", 1, t) for i, t in enumerate(texts)], "doc_id long, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(len(texts))], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r.marks for r in catalog._model_input(spark, str(tmp_path)).collect()}
    assert got == {i: None if t is None else sum(c in "*#$%&|!" for c in t) for i, t in enumerate(texts)}
