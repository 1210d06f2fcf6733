"""Ledger verdicts on planted faults, announced starters, stored fits, and figures that later days do not move."""

from __future__ import annotations

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from fungo.operators import asof, evaluators, frequency, ledger, markets, pricing, quality, slate
from fungo.sources import feeds

NOW = datetime(2026, 7, 1, 14, 0)
LEDGER = "dataset string, day date, rows_n long, games long, bytes long, ingested_at timestamp, verified_at timestamp"


def _ledger(days=60):
    rows = []
    for i in range(days):
        day = date(2026, 6, 30) - timedelta(days=days - i)
        at = datetime.combine(day, datetime.min.time()) + timedelta(days=1, hours=16)
        for name, n, games, per in (("pitches", 4300 + i % 7, 15, 68), ("at_bats", 1120 + i % 5, 15, 25), ("games", 15, 15, 590)):
            rows.append([name, day, n, games, n * per, at, at])
    return rows


def _statuses(spark, rows):
    frame = spark.createDataFrame([tuple(r) for r in rows], LEDGER)
    found = ledger.verdicts(frame, quality.scored_days(quality.ingest_frame(frame)), F.lit(NOW))
    return {r["check"]: (r["status"], list(r["evidence"])) for r in found.collect()}


def _changed(rows, day_back, dataset=None, **new):
    names = ["dataset", "day", "rows_n", "games", "bytes", "ingested_at", "verified_at"]
    day = date(2026, 6, 30) - timedelta(days=day_back)
    return [[new[n] if n in new else v for n, v in zip(names, r, strict=True)] if r[1] == day and dataset in (None, r[0]) else r for r in rows]


def test_a_healthy_ledger_passes_and_each_fault_turns_its_check(spark):
    healthy = _ledger()
    assert {s for s, _ in _statuses(spark, healthy).values()} == {"pass"} and len(_statuses(spark, healthy)) == 8
    last = date(2026, 6, 29)
    faults = {
        "volume": _changed(healthy, 1, "pitches", rows_n=2000, bytes=2000 * 68),
        "size": _changed(healthy, 1, "pitches", bytes=4300 * 200),
        "lag": _changed(healthy, 1, "games", ingested_at=datetime(2026, 7, 1, 13)) and _changed(healthy, 3, None, ingested_at=datetime(2026, 7, 1, 13)),
        "verification": _changed(healthy, 1, "games", verified_at=None),
        "alignment": [r for r in healthy if not (r[0] == "games" and r[1] == last)],
        "gaps": [r for r in healthy if r[1] != last - timedelta(days=4)],
        "freshness": [[*r[:5], r[5] - timedelta(days=3), r[6]] for r in healthy],
        "currency": [r for r in healthy if r[1] < last - timedelta(days=2)],
    }
    for check, rows in faults.items():
        found = _statuses(spark, rows)
        assert found[check][0] != "pass", check
    assert _statuses(spark, faults["alignment"])["alignment"] == ("fail", ["games:2026-06-29"])
    assert _statuses(spark, faults["gaps"])["gaps"] == ("warn", ["2026-06-25..2026-06-25"])
    assert _statuses(spark, faults["verification"])["verification"] == ("warn", ["games:2026-06-29"])
    empty = spark.createDataFrame([], LEDGER)
    assert {r["check"]: r["status"] for r in ledger.verdicts(empty, quality.scored_days(quality.ingest_frame(empty)), F.lit(NOW)).collect()}["freshness"] == "fail"


def test_overall_is_the_worst(spark):
    frame = spark.createDataFrame([("a", "pass"), ("b", "warn"), ("c", "fail"), ("d", "warn")], "check string, status string")
    assert tuple(ledger.overall(frame).first()) == ("fail", "1 failing, 2 to watch of 4 checks")
    assert tuple(ledger.overall(frame.where("status = 'pass'")).first()) == ("pass", "1 checks pass")


SCHEDULE = """{"dates":[{"games":[
 {"gamePk":1,"officialDate":"2026-07-01","teams":{"home":{"team":{"id":10},"probablePitcher":{"id":501,"fullName":"A One"}},"away":{"team":{"id":11}}}},
 {"gamePk":2,"officialDate":"2026-07-01","teams":{"home":{"team":{"id":12}},"away":{"team":{"id":13}}}},
 {"gamePk":1,"officialDate":"2026-07-01","teams":{"home":{"team":{"id":10}},"away":{"team":{"id":11},"probablePitcher":{"id":502,"fullName":"B Two"}}}}]}]}"""


def test_announced_starters_reach_the_expected_runs(spark):
    found = feeds.probable_starters(spark.createDataFrame([(SCHEDULE,)], "doc string"))
    assert {r["game_pk"]: (r["home_pitcher_id"], r["away_pitcher_id"], r["away_pitcher"]) for r in found.collect()} == {1: (501, 502, "B Two"), 2: (None, None, None)}
    games = spark.createDataFrame([(1, 10, 11, 5), (2, 10, 11, 5)], "game_pk long, home_team_id int, away_team_id int, venue_id int")
    rates = spark.createDataFrame([(10, 4.4, 4.4, 50), (11, 4.4, 4.4, 50)], "team_id int, rs_pg double, ra_pg double, games long")
    parks = spark.createDataFrame([], "venue_id int, factor double")
    aces = spark.createDataFrame([(501, 0.33, 0.04, 400), (502, None, None, None)], "pitcher_id int, k_rate double, bb_rate double, pa long")
    plain = {r["game_pk"]: r["mu"] for r in pricing.game_totals(games, rates, parks).collect()}
    known = {r["game_pk"]: r["mu"] for r in pricing.game_totals(games, rates, parks, found, aces).collect()}
    assert plain[1] == plain[2] == pytest.approx(8.8) and known[2] == plain[2] and known[1] < plain[1] - 0.3


def _season(spark, hot: bool):
    """A pitcher who throws 40 pitches a day for 20 days; with ``hot``, much faster and nearer the zone in the last ones."""
    rows = []
    for d in range(20):
        fast = hot and d >= 15
        for k in range(40):
            rows.append((d + 1, k // 4, k % 4 + 1, 7, 30, date(2026, 5, 1) + timedelta(days=d), k % 4, k % 3, 0, 1, k % 8 < 4, "FF", 99.0 if fast else 92.0, 5 if fast or k % 2 else 12, "called_strike", "strike_foul", False, False))
    names = "game_pk long, at_bat_index int, pitch_number int, pitcher_id int, batter_id int, game_date date, balls int, strikes int, outs int, inning int, top_inning boolean, pitch_type string, start_speed double, zone int, description string, result_category string, is_ball boolean, is_in_play boolean"
    p = spark.createDataFrame(rows, names)
    a = p.groupBy("game_pk", "at_bat_index").agg(F.min("pitcher_id").alias("pitcher_id"), F.min("batter_id").alias("batter_id"), F.min("game_date").alias("game_date"), F.lit("out").alias("result"))
    g = p.select("game_pk", "game_date", F.lit("Final").alias("status")).distinct()
    return p, a, g


def test_later_days_do_not_move_earlier_scores(spark):
    done = spark.createDataFrame([], "game_pk long, at_bat_index int, pitch_number int, market string")
    out = []
    for hot in (False, True):
        p, a, g = _season(spark, hot)
        rows = slate.backfill(p, a, g, done, F.lit("2026-06-01")).collect()
        out.append({(r["game_pk"], r["at_bat_index"], r["pitch_number"], r["market"]): (r["predicted_value"], r["confidence"], r["recommendation"]) for r in rows})
    assert out[0].keys() == out[1].keys()
    early = [k for k in out[0] if k[0] <= 16]  # the first hot day is game 16, and its own calls do not see it
    assert all(out[0][k] == out[1][k] for k in early)
    late = [k for k in out[0] if k[0] == 20 and k[3] == "pitch_speed_ou"]
    assert all(out[1][k][0] > out[0][k][0] for k in late)
    once = [k for k in out[0] if k[3] == "ab_pitches_ou"]
    assert len(once) == len({k[:2] for k in once}) == 200 and all(k[2] == 0 for k in once)


def test_backfill_writes_only_what_is_missing_and_published_rows_stay(spark):
    p, a, g = _season(spark, False)
    done = p.where("game_pk = 1").select("game_pk", "at_bat_index", (F.col("pitch_number") - 1).alias("pitch_number"), F.lit("pitch_result").alias("market"))
    rows = slate.backfill(p, a, g, done.unionByName(done.withColumn("market", F.lit("ab_pitches_ou"))), F.lit("2026-06-01"))
    assert rows.where("game_pk = 1").count() == 0 and rows.where("game_pk = 2 and market = 'pitch_result'").count() == 40
    first = spark.createDataFrame([(1, "m", "pregame", 0.5)], "game_pk long, market string, phase string, predicted_value double")
    later = spark.createDataFrame([(1, "m", "pregame", 0.9), (2, "m", "pregame", 0.7)], first.schema)
    assert sorted(map(tuple, slate.publish_frozen(first, later).collect())) == [(1, "m", "pregame", 0.5), (2, "m", "pregame", 0.7)]


def test_sums_before_leave_the_day_itself_out(spark):
    days = spark.createDataFrame([(1, date(2024, 12, 30), 1), (1, date(2025, 4, 1), 10), (1, date(2025, 4, 2), 100), (1, date(2025, 6, 1), 1000)], "who int, day date, n long")
    asked = spark.createDataFrame([(1, date(2025, 4, 2)), (1, date(2025, 4, 3)), (2, date(2025, 4, 3))], "who int, day date")
    got = asof.sums_before(days, ["who"], "day", asked, ["n"], {"d30": 30, "season": "season", "ever": None, "back": ("seasons", 0)})
    assert {(r["who"], r["day"].day): tuple(r)[2:] for r in got.collect()} == {(1, 2): (10, 10, 11, 10), (1, 3): (110, 110, 111, 110), (2, 3): (0, 0, 0, 0)}


def test_frequency_predictor_uses_what_there_is(spark):
    rows = [(1, None, None, 0.60, 800, "R", "L"), (2, 0.5, 1000, None, None, None, "S"), (3, 0.5, 1000, 0.50, 10, "R", "R")]
    ctx = spark.createDataFrame(rows, "id int, f_strike_foul_rate double, f_pitches long, p_zone_rate double, p_pitches long, pitch_hand string, bat_side string").withColumns({"f_ball_rate": F.col("f_strike_foul_rate") * 0.6, "f_in_play_rate": F.col("f_strike_foul_rate") * 0.4, "balls": F.lit(3), "strikes": F.lit(0)})
    got = {r["id"]: r for r in frequency.predict(ctx, "pitch_result", ["id"]).collect()}
    assert got[1]["features_used"] == ["league_avg", "pitcher_rolling"] and got[1]["sample_size"] == 800
    assert got[2]["features_used"] == ["pitcher_freq"] and got[3]["features_used"] == ["pitcher_freq"] and got[3]["sample_size"] == 1000
    assert all(abs(sum(r[f"p_{k}"] for k in ("strike_foul", "ball", "in_play")) - 1) < 1e-3 for r in got.values())
    hands = {r["id"]: r["features_used"] for r in frequency.predict(ctx, "ab_result", ["id"]).collect()}
    assert hands == {1: ["league_avg", "platoon"], 2: ["league_avg"], 3: ["league_avg", "platoon"]}
    with pytest.raises(ValueError, match="no predictor"):
        frequency.predict(ctx, "nothing", ["id"])


def test_stored_fits_are_checked_and_unknown_families_raise(spark):
    cells = spark.createDataFrame([(2020, 1, 60.0), (2020, 0, 40.0)], "season int, home_win int, n double")
    spec = markets.spec_of("game_moneyline")
    fits = evaluators.stored_fits(spark, [("x", "game_moneyline", {"type": "log5", "home_adv": 0.6}), ("y", "pitch_result", {"type": "log5", "home_adv": 0.1})])
    got = {(r["fit_id"], r["metric"]): r["value"] for r in evaluators.scored(cells, fits, spec).collect()}
    assert got == {("x", "brier"): 0.24, ("x", "home_adv"): 0.6}
    with pytest.raises(ValueError, match="incomplete"):
        evaluators.stored_fits(spark, [("z", "m", {"type": "linear", "features": ["a"], "coef": [1.0], "intercept": 0.0})])
    broken = markets.MarketSpec("odd", "log5", lambda p, a, g: g)
    object.__setattr__(broken, "family", "forest")
    with pytest.raises(NotImplementedError, match="forest"):
        evaluators.scored(cells, fits, broken)
    with pytest.raises(ValueError, match="unknown market"):
        markets.spec_of("rain")
    bad = evaluators.stored_fits(spark, [("w", "pitch_speed_ou", {"type": "linear", "features": ["wind"], "coef": [1.0], "intercept": 0.0, "sigma": 1.0, "form_window": "d30"})])
    speed = spark.createDataFrame([(2020, 0, 0, 1, 0, 0, 0, 90.0, 1.0, 5)], "season int, balls int, strikes int, pitch_of_pa int, career_velo_bucket int, d30_velo_bucket int, d90_velo_bucket int, mean_speed double, var_speed double, n long")
    with pytest.raises(Exception, match="no feature wind"):
        evaluators.scored(speed, bad, markets.spec_of("pitch_speed_ou")).collect()
