"""The graded feed on odd places and unknown players, and what of it travels."""

from __future__ import annotations

import re
from datetime import date

from fungo.operators import reports
from fungo.plans import catalog

CALLS = "id long, game_pk long, at_bat_index int, pitch_number int, market string, recommendation string, predicted_value double, line double, confidence double, result string, actual_value double, actual_label string, profit_units double, backfilled boolean"
PITCHES = "game_pk long, at_bat_index int, pitch_number int, inning int, top_inning boolean, balls int, strikes int, outs int, pitch_type string"


def _call(i, game, pa, k, result="win", predicted=None, actual=None):
    return (i, game, pa, k, "m", "over", predicted, 90.5, 0.6, result, actual, "over", 1.0, False)


def _feed(spark, graded_only=False):
    places = [(1, 0, 0), (1, 0, 0), (1, 0, 1), (1, 0, 2), (1, 0, 3), (1, 1, 0), (1, 2, 0), (1, None, 0), (1, 0, None), (9, 0, 0), (None, 0, 0), (2, 0, 1)]
    calls = [_call(i, *p, predicted=92.0 if i == 0 else None, actual=90.5 if i == 0 else None, result=None if i == 3 else "win") for i, p in enumerate(places)]
    pitches = [(1, 0, 1, 1, True, None, 0, 0, "FF"), (1, 0, 2, 1, True, 1, 0, 0, None), (1, 0, 4, 1, True, 2, 2, 1, "CH"), (1, 1, 1, 2, False, 3, 2, 2, "SL"), (1, None, 1, 7, True, 3, 1, 0, "XX"), (1, 0, None, 8, True, 3, 1, 0, "YY"), (2, 0, 1, None, None, 0, 1, 2, "SI"), (2, 0, 1, None, None, 0, 1, 2, "SI")]
    at_bats = [(1, 0, 5, 6), (1, 0, 7, 6), (1, 1, 8, None), (1, None, 55, 66), (2, 0, 6, 5)]
    games = [(1, date(2026, 5, 1), 10, 11), (1, date(2026, 5, 1), 10, 11), (2, date(2026, 5, 2), 12, None), (3, date(2026, 5, 2), 1, 2)]
    names = [(5, "Five"), (5, "A Five"), (6, "Six"), (None, "Nobody")]
    frame = spark.createDataFrame
    return reports.graded_feed(
        frame(calls, CALLS), frame(games, "game_pk long, game_date date, away_team_id int, home_team_id int"), frame(at_bats, "game_pk long, at_bat_index int, pitcher_id int, batter_id int"), frame(pitches, PITCHES), frame(names, "player_id int, full_name string"), graded_only
    )


def test_situation_next_pitch_and_players_of_each_call(spark):
    told = {r["id"]: r for r in _feed(spark).collect()}
    columns = ("official_date", "pitcher_id", "batter_id", "pitcher_name", "batter_name", "inning", "half", "count_text", "outs", "next_pitch_type")
    first, second = date(2026, 5, 1), date(2026, 5, 2)
    known, nothing = (first, 5, 6, "A Five", "Six"), (None,) * 5
    assert {i: tuple(r[c] for c in columns) for i, r in told.items()} == {
        0: (*known, 1, "top", "0-0", 0, "FF"),  # before the first pitch
        1: (*known, 1, "top", "0-0", 0, "FF"),  # a second call at the same place
        2: (*known, 1, "top", "0-0", 0, None),  # at the first pitch, whose balls are not known
        3: (*known, 1, "top", "1-0", 0, None),  # number three is missing: nothing comes next
        4: (*known, *nothing[:4], "CH"),  # no pitch at the place itself
        5: (first, 8, None, None, None, 2, "bottom", "0-0", 2, "SL"),
        6: (first, *nothing[:4], *nothing),  # no such plate appearance
        7: (first, *nothing[:4], *nothing),  # rows without a place meet nothing
        8: (*known, *nothing),
        11: (second, 6, 5, "Six", "A Five", None, None, "0-1", 2, None),  # a pitch listed twice
    }
    assert told[0]["miss"] == 1.5 and told[0]["game_label"] == "10 @ 11" and told[11]["game_label"] == "12"
    assert {r["id"] for r in _feed(spark, graded_only=True).collect()} == set(told) - {3}


def _travels(df) -> int:
    """Shuffles that carry the recommendation of calls."""
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return len(re.findall(r"\) Exchange\nInput \[\d+\]: \[[^\]]*(?:recommendation|__row)#", plan))


def test_calls_do_not_travel_by_position_or_player(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        # the tables lie by game once they are derived, and nothing moves the calls again
        assert _travels(catalog.QUERIES["v6_graded_feed"](spark, "/root/testdata/sf0.001")) == 0
        # of calls that lie anywhere: once to their games, once to their plate appearances
        assert _travels(_feed(spark)) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
