"""Training a market: what is chosen, what it sees, and the registry's actions."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from fungo.operators import markets, training


@pytest.fixture(scope="module")
def games(spark):
    """Home sides win 70 % in old seasons and 50 % in late ones, 90 % in the held-out one."""
    rows = [(s, w, float(round(1000 * (share if w else 1 - share)))) for s, share in ((2018, 0.7), (2019, 0.7), (2020, 0.5), (2021, 0.5), (2022, 0.5), (2023, 0.9)) for w in (0, 1)]
    return spark.createDataFrame(rows, "season int, home_win int, n double")


def test_young_seasons_win_and_the_held_out_one_is_not_seen(spark, games):
    spec = markets.spec_of("game_moneyline")
    got = training.train(games, spec, range(2019, 2024), 2023, half_lives=(None, 0.5))
    assert got.half_life == 0.5 and got.out_of_sample["brier"] < 0.27
    assert got.holdout["home_adv"] < 0.55 and got.params["home_adv"] > 0.7
    assert got.promote and got.reason == "no incumbent"
    worse = training.train(games, spec, range(2019, 2024), 2023, half_lives=(None,), incumbent={"brier": 0.2})
    assert not worse.promote and "worse" in worse.reason
    alone = training.train(games.where("season < 2023"), spec, range(2019, 2024), 2023, half_lives=(None,))
    assert alone.holdout is None
    with pytest.raises(ValueError, match="no season"):
        training.sweep(games.where("season = 2018"), spec, [2018])


def test_a_sweep_scores_each_season_by_the_fit_before_it(spark, games):
    spec = markets.spec_of("game_moneyline")
    found = training.sweep(games, spec, [2019, 2020], (None,)).where("metric = 'brier'").first()
    want = ((0.7 - 1) ** 2 * 0.7 + 0.7**2 * 0.3 + (0.7 - 1) ** 2 * 0.5 + 0.7**2 * 0.5) / 2
    assert found["value"] == pytest.approx(want, abs=1e-6) and found["folds_used"] == 2


def test_registry_takes_versions_and_goes_back(spark):
    rows = [("m", "v1", "{}", "{}", False, "2024-01-01"), ("m", "v2", "{}", "{}", True, "2024-02-01"), ("k", "v1", "{}", "{}", True, "2024-01-01")]
    registry = spark.createDataFrame(rows, "market string, version string, params string, metrics string, is_active boolean, at string").withColumn("activated_at", F.to_timestamp("at")).drop("at")
    more = training.inserted(registry, "m", "v3", "{}", "{}")
    assert more.where("is_active").count() == 2 and more.count() == 4
    with pytest.raises(ValueError, match="has a version"):
        training.inserted(more, "m", "v2", "{}", "{}")
    back = training.rolled_back(more, "m", F.lit("2024-03-01"))
    assert {(r["market"], r["version"]) for r in back.where("is_active").collect()} == {("m", "v1"), ("k", "v1")}
    with pytest.raises(ValueError, match="no earlier"):
        training.rolled_back(registry, "k", F.lit("2024-03-01"))
