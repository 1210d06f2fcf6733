"""Continuous queries: ingest without replays, live state, once-only scoring, settlement and windowed rollups."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, ts: str = "ts", files_per_trigger: int | None = None) -> DataFrame:
    """A stream of Parquet files; event time as an instant."""
    r = spark.readStream.schema(schema)
    r = r.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else r
    return r.parquet(path).withColumn(ts, F.col(ts).cast("timestamp"))


def without_replays(events: DataFrame, keys: Sequence[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each natural key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling_counts(events: DataFrame, keys: Sequence[str], value: str, width: str, ts: str = "ts", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Count and sum in tumbling (or sliding) windows."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    g = events.withWatermark(ts, late).groupBy(w.alias("w"), *keys)
    return g.agg(F.count("*").alias("n"), F.round(F.sum(value), 6).alias("total")).select(F.col("w.start").alias("window_start"), *keys, "n", "total")


def sessions(events: DataFrame, key: str, gap: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Runs of events of a key without a gap of this length."""
    g = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key)
    return g.agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


LIVE_SCHEMA = "key long, last_ts timestamp, last_type string, n long, closed boolean"


def live_state(events: DataFrame, key: str, kind: str = "event_type", ts: str = "ts", late: str = "10 minutes", idle: str = "20 minutes") -> DataFrame:
    """The newest event of each key, sent on only when it changes; a key idle in event time is closed.

    State is one row a key, whatever the number of its events.
    """

    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, kind_, n = state.get
            state.remove()
            yield pd.DataFrame({"key": [k[0]], "last_ts": [pd.Timestamp(last, unit="us")], "last_type": [kind_], "n": [n], "closed": [True]})
            return
        last, kind_, n = state.get if state.exists else (-1, None, 0)
        before = last
        for b in batches:
            n += len(b)
            us = b["ts"].astype("datetime64[us]").astype("int64")
            i = us.idxmax()
            if int(us[i]) > last:
                last, kind_ = int(us[i]), b["kind"][i]
        state.update((last, kind_, n))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        if last != before:
            yield pd.DataFrame({"key": [k[0]], "last_ts": [pd.Timestamp(last, unit="us")], "last_type": [kind_], "n": [n], "closed": [False]})

    slim = events.withWatermark(ts, late).select(F.col(key).cast("long").alias("key"), F.col(ts).alias("ts"), F.col(kind).alias("kind"))
    return slim.groupBy("key").applyInPandasWithState(step, LIVE_SCHEMA, "last long, kind string, n long", "append", GroupStateTimeout.EventTimeTimeout)


def settle_stream(calls: DataFrame, events: DataFrame, key: str, within: str, late: str = "10 minutes") -> DataFrame:
    """Calls (key, call_id, call_ts) with the first event of their key that follows within a time.

    A left outer join of two streams, and the earliest match of each call; a call
    without an event comes out with nulls once the watermark has passed its
    time, and is void. Every call comes out once.
    """
    c = calls.withWatermark("call_ts", late)
    e = events.select(F.col(key).alias("e_key"), F.col("ts").alias("event_ts"), F.col("event_type").alias("happened")).withWatermark("event_ts", late)
    cond = (F.col(key) == F.col("e_key")) & (F.col("event_ts") > F.col("call_ts")) & (F.col("event_ts") <= F.col("call_ts") + F.expr(f"interval {within}"))
    first = F.min(F.when(F.col("event_ts").isNotNull(), F.struct("event_ts", "happened"))).alias("first")
    return c.join(e, cond, "left").groupBy(*calls.columns).agg(first).select(*calls.columns, "first.event_ts", "first.happened")


def once_each(batch_sink: Callable[[DataFrame], None], path: str, keys: Sequence[str], day: str | None = None) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: hand on rows whose keys no other batch under ``path`` has.

    The batch's keys are noted under its number before its rows are handed on, so
    a batch that comes again after a failure gets the same rows, and a sink that
    writes by batch is not given any of them in another one. With ``day`` (a column
    of the keys) notes lie by day, and only the days of the batch are read; days
    behind the watermark can be deleted.
    """
    parts = [day, "epoch"] if day else ["epoch"]

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(list(keys))
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
            seen = spark.read.schema(T.StructType([*(batch.schema[k] for k in keys), T.StructField("epoch", T.LongType())])).parquet(path).where(F.col("epoch") != epoch)
            if day:
                seen = seen.join(F.broadcast(batch.select(day).distinct()), day, "left_semi")  # the days of one batch
            rows = rows.join(seen, list(keys), "left_anti")
        rows = rows.persist()
        try:
            rows.select(*keys, F.lit(epoch).cast("long").alias("epoch")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)
            batch_sink(rows)
        finally:
            rows.unpersist()

    return run


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Drive a stream over what is there and return what came out, as a table."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def stale(last: Column, as_of: Column, minutes: int = 30) -> Column:
    """Whether an instant is more than so many minutes before ``as_of``."""
    return last < as_of - F.make_dt_interval(mins=F.lit(minutes))
