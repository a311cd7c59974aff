from lakeloom.streaming.windows import read_folder, sessions, tumbling


def test_stream_and_batch_agree(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").select("ts", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = tumbling(read_folder(spark, str(tmp_path / "in"), "ts timestamp, event_type string"), "ts", "1 day", ["event_type"], "30 days")
    q = stream.writeStream.format("memory").queryName("windows_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    batch = tumbling(events, "ts", "1 day", ["event_type"], "30 days")
    key = lambda r: (r.event_type, r.start, r.n)
    assert sorted(map(key, spark.table("windows_out").collect())) == sorted(map(key, batch.collect()))


def test_sessions_hold_all_events(spark, data):
    events = spark.read.parquet(f"{data}/events.parquet")
    assert sum(r.n for r in sessions(events, "ts", "10 minutes", ["user_id"], "1 day").collect()) == events.count()
