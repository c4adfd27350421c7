from pyspark.sql import functions as F

from gleaner.operators.incremental import latest_state, trailing_streak
from gleaner.sources import readers
from gleaner.streaming import stateful


def test_notes_and_json(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.md").write_text("# 正文\nhi")
    (tmp_path / "a/y.txt").write_text("no")
    assert [r.text for r in readers.notes(spark, str(tmp_path)).collect()] == ["# 正文\nhi"]
    readers.write_jsonl(spark.createDataFrame([(1, "a")], "id int, t string"), str(tmp_path / "j"))
    assert readers.json_records(spark, str(tmp_path / "j"), "id int, t string").collect()[0].t == "a"
    got = readers.settings(spark.createDataFrame([("a.b", " "), ("c", "5")], "key string, value string"), {"a.b": "1", "c": "2", "d": "3"})
    assert {r.key: r.value for r in got.collect()} == {"a.b": "1", "c": "5", "d": "3"}


def test_decoded(spark):
    rows = spark.createDataFrame([(bytearray("中文".encode("gb18030")),), (bytearray(b"\xef\xbb\xbfhi"),)], "b binary")
    assert {r.x for r in rows.select(readers.decoded(F.col("b")).alias("x")).collect()} == {"中文", "hi"}


def test_streams_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src = tmp_path / "src"
    events.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(src)).select("user_id", "event_type", "event_id", "value")
    q = stateful.upsert_stream(stream, ["user_id", "event_type"], "event_id", str(tmp_path / "state"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    got = {(r.user_id, r.event_type): r.value for r in stateful.latest_version(spark, str(tmp_path / "state")).collect()}
    want = {(r.user_id, r.event_type): r.value for r in latest_state(events, ["user_id", "event_type"], ["event_id"], ["value"]).collect()}
    assert got == want
    one = tmp_path / "one"
    events.coalesce(1).write.parquet(str(one))
    s = stateful.cooldown_stream(spark.readStream.schema(events.schema).parquet(str(one)).select("user_id", "event_type", "ts"))
    q = s.writeStream.format("memory").queryName("cool").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    streak = {r.user_id: r.streak for r in trailing_streak(events, ["user_id"], "event_id", F.col("event_type") == "error").collect()}
    assert {r.user_id: r.streak for r in spark.sql("SELECT * FROM cool").collect()} == streak


def test_cooldown_ends(spark, tmp_path):
    """A user who falls silent after three errors is closed by the time limit, in the stream and as of a time."""
    from compare import SF, compare

    from gleaner.operators.incremental import cooling
    from gleaner.plans import catalog

    at = lambda s: f"timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, {s})"
    rows = lambda *r: spark.sql(" UNION ALL ".join(f"SELECT {u}L AS user_id, '{k}' AS event_type, {at(s)} AS ts, {s}L AS event_id" for u, k, s in r))
    first = rows((1, "error", 10), (1, "error", 20), (1, "error", 30), (3, "error", 1), (3, "view", 2))
    later = rows((2, "view", 1000))
    src, out = str(tmp_path / "in"), []
    columns = ["user_id", "event_type", "ts"]
    first.select(*columns).coalesce(1).write.parquet(src)

    def go():
        s = stateful.cooldown_stream(spark.readStream.schema(first.select(*columns).schema).parquet(src))
        keep = lambda batch, _: out.extend(map(tuple, batch.collect()))
        s.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(100)

    go()
    assert sorted(out) == [(1, 3, True), (3, 0, False)]
    out.clear()
    later.select(*columns).coalesce(1).write.mode("append").parquet(src)
    go()
    assert sorted(out) == [(1, 3, False), (2, 0, False)]
    for seconds, want in ((25, False), (30, True), (329, True), (330, False)):
        got = cooling(first, ["user_id"], "event_id", "ts", F.col("event_type") == "error", F.expr(at(seconds))).collect()
        assert {r.user_id: r.cooling for r in got} == {1: want, 3: False}
    compare(spark, SF, catalog.QUERIES["q_error_cooldown"], catalog.ORACLES["q_error_cooldown"])
