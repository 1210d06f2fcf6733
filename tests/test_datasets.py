"""Day partitions, the ledger, publishing, upserts and retention."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from fungo.sources import datasets as D


def _games(spark, rows):
    return spark.createDataFrame(rows, "game_pk long, game_date date, season int, home_score int")


def test_days_are_replaced_whole_and_alone(spark, tmp_path):
    path = str(tmp_path / "games")
    D.write_days(_games(spark, [(1, date(2026, 4, 1), 2026, 3), (2, date(2026, 4, 2), 2026, 4)]), "games", path)
    D.write_days(_games(spark, [(3, date(2026, 4, 2), 2026, 9)]), "games", path)
    got = sorted((r["game_pk"], r["home_score"]) for r in D.read_dataset(spark, path, "games").collect())
    assert got == [(1, 3), (3, 9)]
    assert "temp_f" in D.read_dataset(spark, path, "games").columns


def test_checksums_ignore_order_and_ledger_forgets_verification(spark):
    df = _games(spark, [(i, date(2026, 4, 1 + i % 2), 2026, i) for i in range(10)])
    for exact in (False, True):
        a = D.day_checksums(df, ["game_pk"], exact=exact).collect()
        b = D.day_checksums(df.orderBy(F.desc("game_pk")), ["game_pk"], exact=exact).collect()
        assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    sums = D.day_checksums(df, ["game_pk"])
    ledger = D.record_ingest(spark.createDataFrame([], D.LEDGER), sums, "games", F.lit("2026-05-01"))
    checked = D.verify_days(ledger, sums, sums)
    assert all(r["ok"] for r in checked.collect())
    marked = D.record_verified(ledger, checked, F.lit("2026-05-02"), "audit")
    assert marked.where("verified_at is not null").count() == 2
    again = D.record_ingest(marked, sums.where("day = date '2026-04-01'"), "games", F.lit("2026-05-03"))
    assert again.where("verified_at is not null").count() == 1
    other = D.day_checksums(df.where("game_pk <> 3"), ["game_pk"])
    assert {r["reasons"] for r in D.verify_days(ledger, other, sums).collect()} == {"", "rows,checksum,readback"}
    assert D.ledgered(df, marked, verified_only=True).count() == 10


def test_partial_days_and_pending_days(spark):
    df = _games(spark, [(1, date(2026, 4, 1), 2026, None), (2, date(2026, 4, 1), 2026, 4), (3, date(2026, 4, 2), 2026, 4)])
    assert [r["game_pk"] for r in D.whole_days(df, F.col("home_score").isNull()).collect()] == [3]
    schedule = spark.createDataFrame([(date(2026, 4, d),) for d in range(1, 6)], "day date")
    ledger = spark.createDataFrame([(date(2026, 4, 2),)], "day date")
    args = (F.lit("2026-04-01").cast("date"), F.lit("2026-04-04").cast("date"))
    assert D.pending_days(schedule, ledger, *args, most=10).count() == 3
    with pytest.raises(Exception, match="saturated"):
        D.pending_days(schedule, ledger, *args, most=3).collect()


def test_publish_refuses_nothing(spark, tmp_path):
    df = _games(spark, [(1, date(2026, 4, 1), 2026, 3)])
    path = str(tmp_path / "out")
    assert D.publish(df, path) == 1
    with pytest.raises(ValueError):
        D.publish(df.limit(0), path)
    assert spark.read.parquet(path).count() == 1


def test_upsert_insert_ignore_and_prune(spark):
    t = spark.createDataFrame([(1, None, "a", 1), (2, "x", "b", 1)], "k int, k2 string, v string, at int")
    n = spark.createDataFrame([(1, None, "c", 2), (3, None, "d", 1), (1, None, "e", 3)], "k int, k2 string, v string, at int")
    assert sorted(r["v"] for r in D.upsert(t, n, ["k", "k2"], F.col("at")).collect()) == ["b", "d", "e"]
    assert sorted(r["v"] for r in D.new_rows(t, n, ["k", "k2"]).collect()) == ["a", "b", "d"]
    odds = spark.createDataFrame([(1, 7, "2026-01-01"), (2, 7, "2026-01-02"), (3, 7, "2026-03-01"), (4, 8, "2026-01-01")], "id int, game_pk int, d string").select("id", "game_pk", F.to_timestamp("d").alias("fetched_at"))
    kept = D.prune_quotes(odds, ["game_pk"], F.lit("2026-03-05").cast("date"))
    assert sorted(r["id"] for r in kept.collect()) == [3, 4]


def test_json_safe_and_coerce(spark):
    df = spark.createDataFrame([(float("nan"), date(2026, 4, 1)), (1.5, None)], "x double, d date")
    assert [tuple(r) for r in D.json_safe(df).collect()] == [(None, "2026-04-01"), (1.5, None)]
    rows = spark.createDataFrame([("1", "2026-04-01", "2.5"), ("x", "soon", None)], "game_pk string, game_date string, home_score string")
    got = [(r["game_pk"], r["game_date"], r["home_score"]) for r in D.coerce(rows, "games").collect()]
    assert got == [(1, date(2026, 4, 1), 2), (None, None, None)]
