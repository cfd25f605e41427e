import pytest
from pyspark.sql import functions as F

from anchorloom.ml import training


def test_models_learn_what_can_be_learnt(spark):
    df = spark.range(300).select("id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("cell_type"), (F.col("id") % 7).alias("f"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    assert training.inputs(df, ["id"]) == ["f"]
    got = training.within(df, "decision_tree", ["id"]).collect()
    assert {r.grp for r in got} == {"A", "B"} and all(r.f1 == 1 for r in got)
    model = training.fit(df, "logistic_regression", ["f"])
    assert training.importances(model, ["f"], spark).first().importance > 0
    with pytest.raises(ValueError, match="model"):
        training.estimator("other")
    tree, dropped = training.estimator("decision_tree", {"max_depth": 40, "num_leaves": 3})
    assert tree.getMaxDepth() == 30 and dropped == ["num_leaves"]


def test_scores_searches_and_runs(spark, tmp_path):
    df = spark.range(200).select("id", F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("cell_type"), (F.col("id") % 7).alias("f"), (F.col("id") % 7 > 3).cast("int").alias("label"))
    split = training.train_test(df, ["id"], 42, 0.3, ["cell_type", "label"])
    assert sum(r.train + r.test for r in training.audit(split, ["id"]).collect()) == 200
    both = split.unionByName(split.withColumn("split", F.lit("test")))
    with pytest.raises(ValueError, match="train and in test"):
        training.audit(both, ["id"])
    assert training.hold_out_score(df, "decision_tree", ["id"]) == 1
    saved = str(tmp_path / "best.json")
    best = training.search_cells(df, "decision_tree", ["id"], saved, trials=0, k=2)
    assert best == {"A": {}, "B": {}} == training.search_cells(df, "decision_tree", ["id"], saved)
    assert training.timed(df, "decision_tree", ["id"], str(tmp_path / "runs"), "one").count() == 2
    assert {r.metric for r in spark.read.parquet(str(tmp_path / "runs")).collect()} == {*training.evaluation.METRICS, "seconds"}
    assert training.refitted(df, "decision_tree", ["id"])[1].first().feature == "f"
