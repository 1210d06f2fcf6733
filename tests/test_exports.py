"""Exports on folders: which days are written, skipped and left alone, and dumps that are read back."""

from __future__ import annotations

import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from fungo.sources import exports as E

D1, D2, D3 = date(2026, 7, 1), date(2026, 7, 2), date(2026, 7, 3)


@pytest.fixture
def tables(spark):
    games = spark.createDataFrame([(1, D1), (1, D1), (2, D2), (3, D3)], "game_pk long, game_date date")
    preds = spark.createDataFrame([(10, 1, "m", {"a": 0.5}, None), (11, 1, "m", None, None), (12, 2, "m", None, "win"), (13, 99, "m", None, None)], "id long, game_pk long, market string, probs map<string,double>, result string")
    picks = spark.createDataFrame([(1, D1, 1, "over"), (2, D2, 2, "under")], "id long, pick_date date, game_pk long, recommendation string")
    calls = spark.createDataFrame([(1, "m", "pregame", D1), (2, "m", "pregame", D2)], "game_pk long, market string, phase string, official_date date")
    return {"predictions": preds, "picks": picks, "game_predictions": calls}, games


def _facts(df):
    return {(r["dataset"], r["day"]): (r["rows"], r["skipped"]) for r in df.collect()}


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}


def test_days_are_written_by_their_games_and_empty_ones_are_not(spark, tables, tmp_path):
    sources, games = tables
    facts = _facts(E.export_days(sources, games, str(tmp_path), [D1, D2, D3]))
    assert facts["predictions", D1] == (2, False) and facts["predictions", D2] == (1, False) and facts["predictions", D3] == (0, False)
    assert E.exported_days(spark, str(tmp_path), "predictions") == {D1, D2}
    rows = E.read_export(spark, str(tmp_path), "predictions").orderBy("id").collect()
    assert [(r["id"], r["official_date"], r["day"]) for r in rows] == [(10, D1, D1), (11, D1, D1), (12, D2, D2)]
    assert rows[0]["probs"] == '{"a":0.5}' and rows[0]["line"] is None
    assert dict(E.read_export(spark, str(tmp_path), "picks").dtypes)["book"] == "string"


def test_existing_days_are_skipped_only_when_whole(spark, tables, tmp_path):
    sources, games = tables
    E.export_days(sources, games, str(tmp_path), [D1])
    E.export_days({"predictions": sources["predictions"]}, games, str(tmp_path), [D2])
    before = _files(tmp_path)
    facts = _facts(E.export_days(sources, games, str(tmp_path), [D1, D2, D3], skip_existing=True))
    assert all(facts[d, D1] == (0, True) for d in sources) and not any(facts[d, D2][1] for d in sources)
    after = _files(tmp_path)
    assert all(after[f] == t for f, t in before.items() if "day=2026-07-01" in f)
    assert E.exported_days(spark, str(tmp_path), "picks") == {D1, D2}


def test_late_grades_reach_an_exported_day(spark, tables, tmp_path):
    sources, games = tables
    E.export_days(sources, games, str(tmp_path), [D1, D2])
    before = _files(tmp_path)
    graded = sources | {"predictions": sources["predictions"].withColumn("result", F.lit("loss"))}
    E.export_days(graded, games, str(tmp_path), [D1])
    got = {r["id"]: r["result"] for r in E.read_export(spark, str(tmp_path), "predictions").collect()}
    assert got == {10: "loss", 11: "loss", 12: "win"}
    assert all(_files(tmp_path).get(f) == t for f, t in before.items() if "day=2026-07-02" in f)
    # a day whose rows are gone from the source keeps what was exported
    E.export_days(graded, games.limit(0), str(tmp_path), [D1])
    assert E.read_export(spark, str(tmp_path), "predictions").count() == 3


def _rows(spark):
    rows = [(i, "m", datetime(2026, 7, 1 + i // 400, 12)) for i in range(1000)] + [(500, f"hot{i}", datetime(2026, 7, 2)) for i in range(900)] + [(2000 + i, None, None) for i in range(7)]
    return spark.createDataFrame(rows, "id long, market string, created_at timestamp")


def test_no_range_of_a_dump_is_too_large(spark, tmp_path):
    ranges = E.cold_dump(_rows(spark), str(tmp_path / "d"), most=100).collect()
    assert max(r["rows"] for r in ranges) <= 100 and sum(r["rows"] for r in ranges) == 1907
    assert {r["day"] for r in ranges} == {"2026-07-01", "2026-07-02", "2026-07-03", "unknown"}
    spans = sorted((r["first_key"], r["last_key"]) for r in ranges if r["day"] == "2026-07-01")
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_a_lost_file_is_found(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = _rows(spark)
    schema = rows.withColumn("day", F.lit("")).schema
    made = E.cold_dump(rows, path, most=100)
    noted = spark.createDataFrame(made.collect(), made.schema)
    E.verify_dump(spark, path, schema, noted)
    os.remove(next(f for f in sorted(_files(path)) if "2026-07-02" in f))
    with pytest.raises(ValueError, match="2026-07-02"):
        E.verify_dump(spark, path, schema, noted)
    with pytest.raises(ValueError, match="nothing"):
        E.cold_dump(rows.limit(0), path)
