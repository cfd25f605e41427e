import re

import pytest

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    import corpus_pipeline
    from anchorloom.llm import common

    first = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = first, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, DATA))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == first.columns
    assert list(seen) == ["quality_rules", "near_join", "personal_data", "source_mix", "packing"]
    assert 0 < seen["near_join"].count() <= seen["quality_rules"].count() <= first.count()
    assert seen["personal_data"].count() == seen["near_join"].count()
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    assert not any(email.search(r.text or "") for r in seen["personal_data"].collect())
    assert {r.doc_id for r in seen["packing"].select("doc_id").collect()} == {r.doc_id for r in seen["source_mix"].select("doc_id").collect()}


@pytest.mark.parametrize("n", range(1, 11))
def test_queries_are_registered(n):
    from anchorloom.llm.queries import QUERIES

    assert sum(q.startswith(f"op{n}_") for q in QUERIES) == 1
