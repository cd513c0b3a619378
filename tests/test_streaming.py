from arcspan.streaming import corridor


def drain(frame, name, mode):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_windows_sessions_and_state(spark, tmp_path):
    rows = [("2024-01-01 00:00:00", "a", 29.9792, 31.1342), ("2024-01-01 00:01:00", "a", 80.0, 0.0), ("2024-01-01 01:00:00", "b", 0.0, 50.0)]
    df = spark.createDataFrame(rows, "ts string, k string, lat double, lon double").selectExpr("cast(ts as timestamp) ts", "k", "lat", "lon")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    drain(corridor.windowed_counts(stream(), "ts", "10 minutes", "5 minutes", [50.0]), "w", "complete")
    assert sorted((r["n"], r["within_50"]) for r in spark.sql("select * from w").collect()) == [(1, 0), (2, 1)]
    drain(corridor.gap_sessions(stream(), ["k"], "ts", "5 minutes", "1 minute"), "s", "complete")
    assert sorted((r["k"], r["n"]) for r in spark.sql("select * from s").collect()) == [("a", 2), ("b", 1)]
    drain(corridor.nearest_so_far(stream(), "k"), "n", "append")
    got = {r["k"]: r for r in spark.sql("select * from n").collect()}
    assert got["a"]["rows"] == 2 and abs(got["a"]["km"] - 6.538312657898132) < 1e-9
