from anchorloom.streaming import annotate


def test_stream_is_counted_against_static_peaks(spark, tmp_path):
    rows = spark.createDataFrame([("A", "1", 0, 10, "2020-01-01 00:00:00"), ("A", "1", 50, 60, "2020-01-01 00:30:00"), ("A", "1", 5, 6, "2020-01-02 00:00:00")], "cell_type string, chr string, start long, end long, ts string").selectExpr("cell_type", "chr", "start", "end", "cast(ts as timestamp) ts")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    peaks = spark.createDataFrame([("A", "1", 5, 8)], "cell_type string, chr string, start long, end long")
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = annotate.counts(stream, peaks).writeStream.outputMode("append").format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert [(r.cell_type, r.overlaps) for r in spark.table("seen").collect()] == [("A", 1)]
