"""Keyed state: replays, disorder and lateness give what a batch over the same rows gives."""

from __future__ import annotations

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fungo.operators import grading as G
from fungo.operators import pricing as R
from fungo.sources.views import Tables
from fungo.streaming import live as L
from fungo.streaming import state as S
from fungo.streaming import tables as T

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 5, 1, 18, 0)
EVENTS = "game_pk long, at_bat_index int, pitch_number int, pitcher_id int, batter_id int, balls int, strikes int, home_score int, away_score int, closes boolean, ts timestamp"


@pytest.fixture(scope="module")
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    S.use_rocksdb(spark)
    yield spark
    spark.conf.set(key, before)


def _game_events(games=5, plate_appearances=9):
    rng, rows = random.Random(4), []
    for g in range(1, games + 1):
        at = T0
        for ab in range(plate_appearances):
            n = rng.randint(0 if ab == plate_appearances - 1 else 1, 6)
            for k in range(n + 1):
                at += timedelta(seconds=20)
                last = k == n and ab < plate_appearances - 1
                rows.append((g, ab, k or None, 10 + (g + ab) % 3, 20 + ab % 9, min(k // 2, 3), min(k // 3, 2), ab // 3, ab // 4, bool(k and last), at))
    return rows


def _feed(spark, path, batches, schema):
    """One file a batch, in order of time written."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i:03d}")
    names = [os.path.join(d, f) for d, _, fs in sorted(os.walk(path)) for f in fs if f.endswith(".parquet")]
    flat = f"{path}-flat"
    os.makedirs(flat)
    for i, n in enumerate(names):
        to = f"{flat}/{i:03d}.parquet"
        os.rename(n, to)
        os.utime(to, (1_700_000_000 + i, 1_700_000_000 + i))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(flat)


def _run(stream, name, checkpoint, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)


def _batch_answer(spark, rows, pitchers, batters):
    e = spark.createDataFrame(rows, EVENTS)
    thrown = e.where("pitch_number is not null")
    ends = e.groupBy("game_pk", "at_bat_index").agg(F.max("closes").alias("closed"))
    todo = R.pending_positions(thrown, thrown.limit(0), ends.where("not closed").select("game_pk", "at_bat_index"), lookback=10_000)
    who = e.groupBy("game_pk", "at_bat_index").agg(F.min("pitcher_id").alias("pitcher_id"), F.min("batter_id").alias("batter_id"))
    count = thrown.select("game_pk", "at_bat_index", "pitch_number", "balls", "strikes").distinct()
    at = todo.join(who, ["game_pk", "at_bat_index"]).join(count, ["game_pk", "at_bat_index", "pitch_number"], "left").fillna(0, ["balls", "strikes"]).withColumn("pitch_number", F.col("pitch_number") + 1)
    ctx = R.scoring_context(at, pitchers, batters)
    probs = R.pitch_result_probs()
    return ctx.select("game_pk", "at_bat_index", (F.col("pitch_number") - 1).alias("pitch_number"), *(F.round(p, 6).alias(f"p_{k}") for k, p in probs.items()))


@pytest.fixture(scope="module")
def figures(spark):
    p = spark.createDataFrame([(10, 900, 200, 0.55, 0.2, 0.25, 0.1, 95.0), (11, 500, 100, 0.41, 0.3, 0.2, 0.05, None)], "pitcher_id int, sample_pitches long, sample_abs long, zone_rate double, whiff_rate double, k_rate double, bb_rate double, fastball_speed double")
    b = spark.createDataFrame([(20 + i, 150, 0.2 + i / 100, 0.7, 0.3, 0.1) for i in range(8)], "batter_id int, sample_abs long, chase_rate double, contact_rate double, k_rate double, bb_rate double")
    return p, b


def test_positions_are_scored_once_in_any_order(rocks, tmp_path, figures):
    rows = _game_events()
    rng = random.Random(1)
    # disorder within two minutes of event time, and everything twice
    mixed = sorted(rows, key=lambda r: r[-1] + timedelta(seconds=rng.randint(0, 120)))
    size = 25
    batches = [mixed[i : i + size] for i in range(0, len(mixed), size)]
    stream = _feed(rocks, str(tmp_path / "e"), [b + batches[max(0, i - 1)][:10] + b for i, b in enumerate(batches)], EVENTS)
    got = _run(S.score_once(stream, *figures, late="4 hours", lookback=20), "once_scored", str(tmp_path / "c"), "append")
    columns = ["game_pk", "at_bat_index", "pitch_number", "p_strike_foul", "p_ball", "p_in_play"]
    want = _batch_answer(rocks, rows, *figures)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, want.select(*columns).collect()))
    once = got.where("first_of_pa").groupBy("game_pk", "at_bat_index").count().collect()
    assert len(once) == len({(r[0], r[1]) for r in rows}) and {r["count"] for r in once} == {1}


def test_positions_out_of_reach_stay_unscored(rocks, tmp_path):
    row = lambda ab, k, closes=False: (1, ab, k, 10, 20, 0, 0, 0, 0, closes, T0 + timedelta(seconds=ab))
    batches = [[row(0, None)], [row(9, None)], [row(0, 1), row(5, 1), row(6, 1)], [row(6, 1), row(6, 2, True)]]
    stream = _feed(rocks, str(tmp_path / "e"), batches, EVENTS)
    got = _run(S.open_positions(stream, late="1 hour"), "reach", str(tmp_path / "c"), "append")
    assert sorted((r["at_bat_index"], r["pitch_number"]) for r in got.collect()) == [(0, 0), (6, 0), (6, 1), (9, 0)]


def test_live_games_change_and_close(rocks, tmp_path):
    at = lambda m: T0 + timedelta(minutes=m)
    row = lambda g, ab, k, batter, m, home=0: (g, ab, k, 10, batter, 0, 0, home, 0, False, at(m))
    batches = [[row(1, 0, 1, 20, 0), row(1, 0, 2, 20, 1)], [row(1, 0, 2, 20, 1)], [row(1, 1, None, 21, 1)], [row(2, 0, 1, 30, 60)], [row(2, 0, 2, 30, 61, 3)]]
    stream = _feed(rocks, str(tmp_path / "e"), batches, EVENTS)
    got = [tuple(r) for r in _run(S.live_games(stream, late="5 minutes"), "games_now", str(tmp_path / "c"), "update").select("game_pk", "status", "at_bat_index", "pitch_count_pa", "batter_id", "home_score").collect()]
    assert sorted(got) == sorted([(1, "In Progress", 0, 2, 20, 0), (1, "In Progress", 1, 0, 21, 0), (2, "In Progress", 0, 1, 30, 0), (2, "In Progress", 0, 2, 30, 3), (1, "Final", 1, 0, 21, 0)])


QUOTES = "id long, game_pk long, source string, price int, fetched_at timestamp"


def test_quotes_expire_like_the_batch_with_its_window(rocks, tmp_path):
    rng = random.Random(2)
    rows = [(i, 1 + rng.randint(0, 11), rng.choice(["a", "b"]), rng.randint(-200, 200), T0 + timedelta(minutes=i // 2, seconds=rng.randint(0, 90))) for i in range(240)]
    rows += [(1000 + i, *r[1:]) for i, r in enumerate(rows[:30])]  # the same instants under other ids
    rows.sort(key=lambda r: r[-1] + timedelta(seconds=(r[0] * 37) % 240))
    rows = [r for r in rows if not (r[1] in (3, 4) and r[-1] > T0 + timedelta(minutes=40))]
    batches = [rows[i : i + 30] for i in range(0, len(rows), 30)]
    late = timedelta(minutes=5)
    stream = _feed(rocks, str(tmp_path / "e"), batches, QUOTES)
    out: list[tuple[int, list]] = []
    q = S.expiring_quotes(stream, ["game_pk", "source"], minutes=30, late="5 minutes").writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda df, i: out.append((i, df.collect()))).trigger(availableNow=True).start()
    q.awaitTermination()
    held: dict[tuple, tuple] = {}
    for _, changes in sorted(out):
        for r in sorted(changes, key=lambda r: (r["expired"], r["fetched_at"], r["id"])):
            if r["expired"]:
                assert held.pop((r["game_pk"], r["source"]))[0] == r["id"]
            else:
                held[r["game_pk"], r["source"]] = (r["id"], r["price"])
    watermark = max(r[-1] for r in rows) - late
    odds = rocks.createDataFrame(rows, QUOTES)
    newest = R.latest_quotes(odds, ["game_pk", "source"])
    want = {(r["game_pk"], r["source"]): (r["id"], r["price"]) for r in newest.where(F.col("fetched_at") >= F.lit(watermark) - F.expr("interval 30 minutes")).collect()}
    assert held == want and any(k[0] in (3, 4) for k in {(r[1], r[2]) for r in rows}) and not any(k[0] in (3, 4) for k in held)


GRADES = "id long, day date, market string, model_version string, result string, confidence double, profit_units double, graded_at timestamp"


def _mtimes(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_late_grades_rewrite_their_day_alone(spark, tmp_path):
    schema = spark.createDataFrame([], GRADES).schema
    day = lambda i: date(2024, 5, 1) + timedelta(days=i)
    first = [(i, day(i % 9), "pitch_result", f"v{i % 2}", ["win", "loss", None][i % 3], 0.5 + i / 100, 1.0 if i % 3 == 0 else -1.0, T0) for i in range(45)]
    late = [(2, day(2), "pitch_result", "v0", "win", 0.52, 0.9, T0 + timedelta(days=7))]
    sink = T.late_grades(str(tmp_path / "g"), str(tmp_path / "r"), schema)
    sink(spark.createDataFrame(first, GRADES), 0)
    before = _mtimes(tmp_path / "r")
    for _ in range(2):  # the same batch once more changes nothing
        sink(spark.createDataFrame(late, GRADES), 1)
        after = _mtimes(tmp_path / "r")
        changed = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
        assert changed and all("day=2024-05-03" in p for p in changed)
        latest = spark.createDataFrame([r for r in first if r[0] != 2] + late, GRADES)
        want = G.accuracy_rollup(latest, "day")
        got = spark.read.parquet(str(tmp_path / "r")).select(*want.columns)
        assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_readers_never_meet_half_a_version(spark, tmp_path):
    path, schema = str(tmp_path / "t"), spark.createDataFrame([], "game_pk long, market string, at long, status string").schema
    sink = T.mirror(path, schema, ["game_pk", "market"], ["at"], alive=F.col("status") != "Final", keep=2)
    frame = lambda rows: spark.createDataFrame(rows, schema)
    assert T.read_version(spark, path, schema).count() == 0
    sink(frame([(1, "m", 1, "In Progress"), (2, "m", 1, "In Progress")]), 0)
    held = T.read_version(spark, path, schema)
    frame([(9, "m", 9, "In Progress")]).write.parquet(f"{path}/version-1")  # a writer that died before its marker
    assert {r["game_pk"] for r in T.read_version(spark, path, schema).collect()} == {1, 2}
    for _ in range(2):
        sink(frame([(1, "m", 0, "old"), (2, "m", 5, "Final"), (3, "n", 2, "In Progress")]), 1)
        assert sorted(map(tuple, T.read_version(spark, path, schema).collect())) == [(1, "m", 1, "In Progress"), (3, "n", 2, "In Progress")]
    assert held.count() == 2  # a slow reader still has its version
    sink(frame([(4, "m", 1, "In Progress")]), 2)
    assert T.complete_versions(spark, path) == [1, 2] and len(os.listdir(path)) == len([n for n in os.listdir(path) if not n.startswith("version-0")])


def test_mirror_of_live_games_by_a_trigger(rocks, tmp_path):
    stream = _feed(rocks, str(tmp_path / "e"), [_game_events(3, 4)[i : i + 12] for i in range(0, 60, 12)], EVENTS)
    games = S.live_games(stream, late="2 hours")
    sink = T.mirror(str(tmp_path / "t"), games.schema, ["game_pk"], ["last_ts", "at_bat_index", "pitch_count_pa"])
    T.snapshot_every(games, sink, str(tmp_path / "c"), every=None).awaitTermination()
    got = {r["game_pk"]: r["last_ts"] for r in T.read_version(rocks, str(tmp_path / "t"), games.schema).collect()}
    want = {}
    for r in _game_events(3, 4)[:60]:
        want[r[0]] = max(want.get(r[0], T0), r[-1])
    assert got == want


def test_windows_still_run_on_the_default_store(spark, tmp_path):
    e = Tables(spark, SF).base("events")
    e.write.parquet(str(tmp_path / "ev"))
    stream = L.read_events(spark, str(tmp_path / "ev"), e.schema)
    assert L.run_available(L.tumbling_counts(stream, ["event_type"], "value", "1 day"), "default_store", str(tmp_path / "c"), "complete").count() > 0
