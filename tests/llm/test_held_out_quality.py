import zlib

DATA = "/root/testdata/sf0.01"


def test_scores_part_held_out_labels(spark):
    from anchorloom.llm.queries import QUERIES

    made = QUERIES["op9_quality_model"](spark, DATA).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality is not None}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= 0.7) for r in made)
    good = [r.score for r in made if r.held_out and labels.get(r.doc_id) == 1]
    bad = [r.score for r in made if r.held_out and labels.get(r.doc_id) == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc >= 0.75, (auc, len(good), len(bad))
