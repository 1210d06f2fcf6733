"""Rolling form never sees the day it is for; carried-forward values never see what comes after."""

from __future__ import annotations

from datetime import date

from fungo.operators import features as X
from fungo.operators import quality as Q
from fungo.sources import play_by_play as N


def test_spine_leaves_the_day_out(spark):
    rows = [(1, date(2026, 4, d), 100.0, 5) for d in (1, 1, 2, 2)] + [(1, date(2026, 4, 3), 1.0, 13)] * 2
    df = spark.createDataFrame(rows, "pitcher_id int, game_date date, start_speed double, zone int")
    out = {r["game_date"]: r for r in X.pitch_spine(df).collect()}
    assert out[date(2026, 4, 1)]["career_n"] == 0 and out[date(2026, 4, 1)]["career_velo"] is None
    last = out[date(2026, 4, 3)]
    assert (last["career_n"], last["career_zone_rate"], last["career_velo"]) == (4, 1.0, 100.0)


def test_null_safe_mean(spark):
    rows = [(1, date(2026, 4, 1), None, 5), (1, date(2026, 4, 2), 90.0, 5), (1, date(2026, 4, 3), 90.0, 5)]
    df = spark.createDataFrame(rows, "pitcher_id int, game_date date, start_speed double, zone int")
    low = {r["game_date"]: r["career_velo"] for r in X.pitch_spine(df).collect()}
    safe = {r["game_date"]: r["career_velo"] for r in X.pitch_spine(df, null_safe=True).collect()}
    assert low[date(2026, 4, 3)] == 45.0 and safe[date(2026, 4, 3)] == 90.0


def test_trailing_baseline_needs_ten_rows_and_excludes_itself(spark):
    df = spark.createDataFrame([("d", i, 100 + i % 3) for i in range(20)] + [("d", 20, 500)], "dataset string, day int, n long")
    out = {r["day"]: r for r in Q.trailing_baseline(df, ["dataset"], "day", "n").collect()}
    assert out[9]["n_median"] is None and out[9]["n_status"] == "pass"
    assert out[20]["n_median"] == 101.0 and out[20]["n_status"] == "fail"


def test_bases_and_score_carry_forward(spark):
    play = '{"result":{"eventType":"%s","homeScore":%s,"awayScore":0},"about":{"atBatIndex":%d,"inning":%d,"isTopInning":true},"matchup":{"pitcher":{"id":9},"batter":{"id":%d},"postOnFirst":%s},"playEvents":[{"type":"pitch","pitchNumber":1,"count":{"balls":1,"strikes":0},"details":{"call":{"code":"B"}}},{"type":"pickoff"},{"type":"pitch","pitchNumber":2,"count":{"balls":1,"strikes":1},"details":{"description":"Foul Tip"}}]}'
    plays = [play % ("single", 1, 0, 1, 1, '{"id":1}'), play % ("walk", "null", 1, 1, 2, "null"), play % ("strikeout", 2, 2, 2, 1, "null")]
    feed = spark.createDataFrame([(7, date(2026, 4, 1), '{"allPlays":[' + ",".join(plays) + "]}"), (8, date(2026, 4, 1), "no json"), (9, date(2026, 4, 1), None)], "game_pk long, game_date date, feed string")
    p = sorted(N.flatten_pitches(feed).collect(), key=lambda r: (r["at_bat_index"], r["pitch_number"]))
    assert [(r["balls"], r["strikes"]) for r in p] == [(0, 0), (1, 0)] * 3
    assert [r["men_on_base"] for r in p[::2]] == ["Empty", "Men_On", "Empty"]
    assert [r["home_score"] for r in p[::2]] == [0, 1, 1]
    assert [r["pitch_of_game"] for r in p] == [1, 2, 3, 4, 5, 6]
    assert [r["times_through_order"] for r in p[::2]] == [1, 1, 2]
    assert [r["result_category"] for r in p[:2]] == ["ball", "strike_foul"]
    a = sorted(N.flatten_at_bats(feed).collect(), key=lambda r: r["at_bat_index"])
    assert [(r["pitch_count"], r["result"]) for r in a] == [(2, "hit"), (2, "walk"), (2, "strikeout")]
