import datetime as dt

from chronoweave.streaming import tracks


def test_buckets_and_sessions(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    rows = [(1, at(0.0), "click", 0.2, 0.4), (1, at(0.5), "movement", 0.9, 0.9), (1, at(1.0), "dwell", 0.4, 0.6), (1, at(5.0), "click", 0.1, 0.1), (1, at(60.0), "click", 0.5, 0.5)]
    df = spark.createDataFrame(rows, "job_id long, ts timestamp, kind string, x double, y double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, q in (("buckets", tracks.focus_buckets(stream)), ("sessions", tracks.clusters(stream))):
        q.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    got = sorted((r.n_clicks, r.n_dwell) for r in spark.table("buckets").collect())
    assert got == [(1, 0), (1, 1)]
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_preference_changes_as_a_stream_and_as_a_table(spark, tmp_path):
    import random
    from datetime import datetime, timedelta

    from chronoweave.operators import review
    from chronoweave.streaming import tracks

    rng, start = random.Random(2), datetime(2026, 1, 1)
    rows = [(rng.choice("pq"), rng.choice(["zoom", "lag"]), start + timedelta(seconds=i), i, rng.choice([None, 1.0, 1.0, 2.0, rng.uniform(0, 3)])) for i in range(200)]
    cols = "profile string, key string, at timestamp, id long, value double"
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], cols).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(cols).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = tracks.preference_changes(stream, 5, 3).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(repr, spark.table("changes").collect()))
    assert got == sorted(map(repr, review.preference_changes(spark.createDataFrame(rows, cols), 5, 3).collect())) and len(got) > 20
