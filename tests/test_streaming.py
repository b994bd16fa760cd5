from kgspark.streaming import limits, wal


def test_log_and_stream(spark, tmp_path):
    path = str(tmp_path / "wal")
    rows = [(1, "upsert", 1, "a"), (2, "upsert", 2, "b"), (3, "delete", 1, None)]
    wal.append(spark.createDataFrame(rows[:2], wal.LOG), path)
    wal.append(spark.createDataFrame(rows[2:], wal.LOG), path)
    assert [(r.key, r.payload) for r in wal.load(spark, path).collect()] == [(2, "b")]
    wal.snapshot(wal.load(spark, path), path, 1)
    wal.append(spark.createDataFrame([(4, "upsert", 3, "c")], wal.LOG), path)
    again = wal.load(spark, path, spark.read.parquet(f"{path}/snapshot/v=1"), high_water=3)
    assert {(r.key, r.payload) for r in again.collect()} == {(2, "b"), (3, "c")}
    out = str(tmp_path / "state")
    wal.fold_stream(wal.stream_changes(spark, path), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.key, r.kind) for r in wal.folded(spark, out).collect()} == {(1, "delete"), (2, "upsert"), (3, "upsert")}
    wal.append(spark.createDataFrame([(5, "upsert", 1, "again")], wal.LOG), path)
    wal.fold_stream(wal.stream_changes(spark, path), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.key, r.payload) for r in wal.folded(spark, out).filter("key = 1").collect()} == {(1, "again")}


def test_token_bucket():
    assert limits.allow([0, 0, 0, 0, 30, 31], 3.0, None, 3.0, 60.0)[0] == [True, True, True, False, True, False]


def test_rate_limited_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.sql("SELECT CAST(id % 2 AS BIGINT) AS key, id AS event_id, TIMESTAMP'2024-01-01' + make_interval(0,0,0,0,0,0,id) AS ts FROM range(8)").write.parquet(src)
    events = spark.readStream.schema("key long, event_id long, ts timestamp").parquet(src)
    q = limits.rate_limited(events, 2, 3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.event_id for r in spark.table("limited").filter("allowed").collect()} == {0, 1, 2, 3}
