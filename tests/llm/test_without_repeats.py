def test_substring_dedup_of_texts_without_repeats(spark):
    from anchorloom.llm import substring_dedup

    rows = [(1, " ".join(f"a{i}" for i in range(60))), (2, " ".join(f"b{i}" for i in range(60)))]
    made = substring_dedup.remove(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_words, r.n_removed, r.kept) for r in made] == [(d, 60, 0, t) for d, t in rows]


def test_language_model_without_training_rows(spark):
    from anchorloom.llm import language_model as lm

    docs = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    made = lm.score(docs, lm.train(docs.limit(0))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.n_known, r.base_score) for r in made] == [(1, 3, 0, 0.0), (2, 1, 0, 0.0)]
