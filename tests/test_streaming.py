"""Streams over what is there give what a batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.streaming import live as L

SF = "/root/testdata/sf0.001"


def _events(spark, tmp_path, twice=False):
    src = str(tmp_path / "events")
    e = spark.read.parquet(f"{SF}/events.parquet")
    (e.unionByName(e) if twice else e).write.parquet(src)
    return e.withColumn("ts", F.col("ts").cast("timestamp")), L.read_events(spark, src, e.schema)


def test_replays_collapse(spark, tmp_path):
    batch, stream = _events(spark, tmp_path, twice=True)
    got = L.run_available(L.without_replays(stream, ["event_id"], late="400 days"), "once", str(tmp_path / "c"))
    assert got.count() == batch.count()


def test_windows_equal_batch(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    got = L.run_available(L.tumbling_counts(stream, ["event_type"], "value", "1 day"), "days", str(tmp_path / "c"), "complete")
    want = batch.groupBy(F.window("ts", "1 day").start.alias("window_start"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_live_state_is_the_newest_event(spark, tmp_path):
    batch, stream = _events(spark, tmp_path)
    got = L.run_available(L.live_state(stream, "user_id", idle="400 days"), "state", str(tmp_path / "c"))
    last = {r["key"]: r["last_ts"] for r in got.groupBy("key").agg(F.max("last_ts").alias("last_ts")).collect()}
    want = {r["user_id"]: r["t"] for r in batch.groupBy("user_id").agg(F.max("ts").alias("t")).collect()}
    assert last == want


def test_once_each_sink(spark, tmp_path):
    done, out = str(tmp_path / "done"), []
    sink = L.once_each(lambda df: out.append(sorted(r["k"] for r in df.collect())), done, ["k"])
    sink(spark.createDataFrame([(1,), (2,), (2,)], "k int"), 0)
    sink(spark.createDataFrame([(2,), (3,)], "k int"), 1)
    assert out == [[1, 2], [3]]


def test_a_batch_that_comes_again_gets_its_rows_again(spark, tmp_path):
    """A sink that fails after the keys are noted is given the same rows when the batch is run once more, and no other batch is."""
    done, out, fails = str(tmp_path / "done"), [], [True]

    def sink(df):
        if fails:
            fails.pop()
            raise OSError("lost")
        out.append(sorted(r["k"] for r in df.collect()))

    once = L.once_each(sink, done, ["k", "d"], day="d")
    first, second = (spark.createDataFrame(rows, "k int, d string") for rows in ([(1, "a"), (2, "b")], [(2, "b"), (3, "b")]))
    try:
        once(first, 0)
    except OSError:
        pass
    once(first, 0)
    once(second, 1)
    once(second, 1)
    assert out == [[1, 2], [3], [3]]


def test_settlement_of_streams(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:05:00", "a"), (1, "2024-01-01 00:07:00", "b"), (1, "2024-01-01 00:30:00", "c"), (9, "2024-01-03 00:00:00", "z")], "user_id int, t string, event_type string").select("user_id", F.to_timestamp("t").alias("ts"), "event_type")
    c = spark.createDataFrame([(1, 10, "2024-01-01 00:00:00"), (2, 20, "2024-01-01 00:00:00"), (9, 90, "2024-01-03 00:00:00")], "user_id int, call_id int, t string").select("user_id", "call_id", F.to_timestamp("t").alias("call_ts"))
    e.write.parquet(str(tmp_path / "e"))
    c.write.parquet(str(tmp_path / "k"))
    es, cs = spark.readStream.schema(e.schema).parquet(str(tmp_path / "e")), spark.readStream.schema(c.schema).parquet(str(tmp_path / "k"))
    got = L.run_available(L.settle_stream(cs, es, "user_id", "10 minutes"), "settled", str(tmp_path / "c"))
    rows = {r["call_id"]: r["happened"] for r in got.collect()}
    assert rows[10] == "a" and rows.get(20, "missing") is None and got.where("call_id = 10").count() == 1
