import __spark_entry__ as entry


def test_queries_and_sql_match():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(sql) >= 40


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["cell_type", "chr", "start", "end", "cnt"] and df.limit(1).count() == 1
