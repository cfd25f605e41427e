def test_tokens_of_any_length_are_candidates(spark):
    from pyspark.sql import functions as F

    from anchorloom.llm.personal_data import WIDER

    tokens = ["a" * 15, "aB3" * 5 + "x", "aB3_" * 32, "aB3-" * 32 + "z", "0f" * 50_000]
    df = spark.createDataFrame([(f"key: {t} end",) for t in tokens], "text string")
    got = [r[0] for r in df.select(F.regexp_extract("text", WIDER["secret"], 0)).collect()]
    assert got == ["", *tokens[1:]]
