import datetime as dt

from pyspark.sql import functions as F

from tessella.operators import tables
from tessella.streaming import state


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def events_in(spark, sf, tmp_path):
    """The events as dropped files, and a closing one far later, so that no burst stays open."""
    e = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "value")
    end = spark.createDataFrame([(10**9, dt.datetime(2030, 1, 1), -1, 0.0)], e.schema)
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    end.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "in"))


def test_debounced_stream_equals_batch(spark, sf, tmp_path):
    batch, stream = events_in(spark, sf, tmp_path)
    want = tables.debounced(batch, "user_id", "ts", "value", "INTERVAL 6 HOURS")
    got = run(state.debounced(stream, "user_id", "ts", "value", "6 hours"), "debounced", "append").where("user_id >= 0")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_bounded_retention_equals_batch(spark, sf, tmp_path):
    batch, stream = events_in(spark, sf, tmp_path)
    got = run(state.newest(stream, "user_id", "ts", 5), "newest", "update").where("user_id >= 0")
    want = tables.newest(batch.select("user_id", "event_id", "ts"), "ts", "event_id", 5, ["user_id"])
    assert sorted((r["user_id"], r["event_id"]) for r in got.collect()) == sorted((r["user_id"], r["event_id"]) for r in want.collect())


def test_drops_are_consumed_once_and_a_batch_can_come_again(spark, tmp_path):
    drop, table, mark = tmp_path / "drop", str(tmp_path / "table"), str(tmp_path / "mark")
    drop.mkdir()
    schema = "id string, ts long, v string"
    (drop / "1.json").write_text('{"id":"a","ts":1,"v":"x"}\n{"id":"a","ts":2,"v":"y"}\n')
    seen = []

    def take(batch, epoch):
        put = state.upsert_into(spark, table, "id", "ts", ["v"])
        put(batch, epoch)
        put(batch, epoch)  # as after a failure
        seen.append(batch.count())

    state.consumed_once(spark, str(drop), schema, mark, take).awaitTermination(60)
    (drop / "2.json").write_text('{"id":"a","ts":5,"v":"z"}\n{"id":"b","ts":4,"v":"w"}\n')
    state.consumed_once(spark, str(drop), schema, mark, take).awaitTermination(60)
    assert seen == [2, 2]
    got = {r["id"]: (r["created"], r["updated"], r["v"]) for r in spark.read.parquet(f"{table}/v=1").collect()}
    assert got == {"a": (1, 5, "z"), "b": (4, 4, "w")}


def test_resume(spark):
    need = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "url string, ord int")
    assert [r["url"] for r in state.resumed(need, need.where("ord = 2"), "url", "ord").collect()] == ["a", "c"]
