"""Landed documents of each kind, flattened."""

from __future__ import annotations

import json
from datetime import date

from fungo.sources import feeds as S


def _docs(spark, *docs):
    return spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(docs)], "game_pk long, doc string")


def test_schedule_and_boxscore(spark):
    game = {"gamePk": 7, "officialDate": "2026-04-01", "season": "2026", "gameType": "R", "status": {"detailedState": "Final"}, "teams": {"home": {"score": 3, "team": {"id": 1, "abbreviation": "AAA"}}, "away": {"score": 2, "team": {"id": 2}}}, "venue": {"id": 5}, "gameDate": "2026-04-01T23:05:00Z"}
    live = {**game, "gamePk": 8, "status": {"detailedState": "In Progress"}}
    docs = _docs(spark, {"dates": [{"games": [game, live]}]}, "broken", None)
    assert S.schedule_games(docs).count() == 2
    r = S.schedule_games(docs, final_only=True).first()
    assert (r["game_pk"], r["game_date"], r["home_abbr"], r["home_score"], r["venue_id"]) == (7, date(2026, 4, 1), "AAA", 3, 5)
    box = {"officials": [{"officialType": "First Base", "official": {"id": 1}}, {"officialType": "Home Plate", "official": {"id": 9, "fullName": "U"}}], "info": [{"label": "Weather", "value": "75 degrees, Partly Cloudy."}, {"label": "Wind", "value": "7 mph, Out To LF."}, {"label": "T", "value": "2:29."}, {"label": "Att", "value": "30,123."}]}
    a, b = sorted(S.boxscore_context(_docs(spark, box, {})).collect(), key=lambda r: r["game_pk"])
    assert tuple(a)[1:] == (9, "U", "Partly Cloudy", 75, 7, "Out To LF", 30123, 149)
    assert all(x is None for x in tuple(b)[1:])


def test_people(spark):
    doc = {"people": [{"id": 1, "fullName": "A", "batSide": {"code": "S"}, "birthDate": "1999-01-02"}, {"fullName": "no id"}]}
    assert [(r["player_id"], r["bat_side"], r["birth_date"]) for r in S.people(_docs(spark, doc)).collect()] == [(1, "S", date(1999, 1, 2))]


def test_quotes(spark):
    board = {"events": [{"competitions": [{"competitors": [{"homeAway": "home", "team": {"abbreviation": "H"}}, {"homeAway": "away", "team": {"abbreviation": "A"}}], "odds": [{"homeTeamOdds": {"moneyLine": -150}, "overUnder": 8.5, "overOdds": -110}]}]}, {"competitions": []}]}
    q = {(r["market"], r["outcome"]): (r["line"], r["price_american"], r["implied_prob"]) for r in S.scoreboard_quotes(_docs(spark, board)).collect()}
    assert q == {("game_moneyline", "home"): (None, -150, 0.6), ("game_total", "over"): (8.5, -110, 0.5238), ("game_total", "under"): (8.5, None, None)}
    doc = {"markets": [{"ticker": "a", "title": "X", "yes_bid": 59, "yes_ask": 61}, {"ticker": "b", "title": "Y", "yes_bid": 0, "yes_ask": 0, "last_price": 25}, {"ticker": "c", "title": "Z", "last_price": 100}, {"ticker": "d", "title": "", "last_price": 50}]}
    assert sorted(tuple(r) for r in S.contract_quotes(_docs(spark, doc)).collect()) == [("a", "X", 0.6, -150), ("b", "Y", 0.25, 300)]
    books = [{"home_team": "H", "away_team": "A", "bookmakers": [{"key": "k", "markets": [{"key": "h2h", "outcomes": [{"name": "H", "price": 120}, {"name": "Draw", "price": 900}]}, {"key": "totals", "outcomes": [{"name": "Over", "price": -105, "point": 9.0}]}]}]}]
    assert sorted((r["market"], r["outcome"], r["line"], r["price_american"]) for r in S.bookmaker_quotes(_docs(spark, books)).collect()) == [("game_moneyline", "home", None, 120), ("game_total", "over", 9.0, -105)]


def test_longest_alias_wins(spark):
    texts = spark.createDataFrame([(1, "New York Mets win"), (2, "the mets"), (3, "nobody")], "id int, t string")
    aliases = spark.createDataFrame([(10, "new york"), (20, "new york mets"), (20, "Mets")], "team_id int, alias string")
    assert {r["id"]: r["team_id"] for r in S.team_of_text(texts, aliases, "t", "id").collect()} == {1: 20, 2: 20, 3: None}
