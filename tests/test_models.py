"""Fits find planted signals; walks use the past only; gates hold."""

from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from fungo.operators import models as M

SPEC = M.MarketSpec("pitch_result", "multinomial", lambda: None, features=("balls", "strikes", "pitcher_zone_delta"), classes=("strike_foul", "ball", "in_play"), step=0.03)


def _cells(spark):
    rows = []
    for season in (2016, 2017, 2018):
        for balls in range(4):
            for bucket in (-2, 0, 2):
                p = [math.exp(0.5 + 8 * 0.03 * bucket), math.exp(0.3 * balls), 1.0]
                rows += [(season, balls, 0, c, bucket, bucket, bucket, int(1000 * x / sum(p))) for c, x in zip(SPEC.classes, p, strict=True)]
    return spark.createDataFrame(rows, "season int, balls int, strikes int, outcome string, career_zone_bucket int, d30_zone_bucket int, d90_zone_bucket int, n long")


def test_multinomial_finds_the_signal(spark):
    cells = _cells(spark)
    params = M.fit_multinomial(cells, SPEC, "career", half_life=2)
    c = dict(zip(params["classes"], params["coef"], strict=True))
    assert c["ball"][0] - c["in_play"][0] == pytest.approx(0.3, abs=0.05)
    assert c["strike_foul"][2] - c["in_play"][2] == pytest.approx(8, abs=1.5)
    scored = M.predict_multinomial(cells, params, SPEC)
    m = M.class_metrics(scored, SPEC.classes).first()
    flat = {**params, "coef": [[0.0] * 3] * 3, "intercept": [0.0] * 3}
    assert m["logloss"] < M.class_metrics(M.predict_multinomial(cells, flat, SPEC), SPEC.classes).first()["logloss"] == pytest.approx(math.log(3), abs=1e-5)
    assert M.calibration_error(M.calibration(scored, "p_ball", F.col("outcome") == "ball")).first()["ece"] < 0.02


def test_walk_forward_uses_the_past_only(spark):
    cells, seen = _cells(spark), []

    def fit(past, season):
        seen.append((season, past.agg(F.max("season")).first()[0]))
        return M.fit_multinomial(past, SPEC, "career")

    folds = M.walk_forward(cells, fit, lambda now, p: M.class_metrics(M.predict_multinomial(now, p, SPEC), SPEC.classes), (2017, 2018))
    assert seen == [(2017, 2016), (2018, 2017)]
    assert M.fold_mean(folds, ["logloss"]).first()["logloss"] < math.log(3)


def test_linear_fit_and_sigma(spark):
    rows = [(2016, b, s, k, k, k, 90 + b - s + 0.5 * k, 4.0, 10, 1) for b in range(4) for s in range(3) for k in (-1, 0, 1)]
    cells = spark.createDataFrame(rows, "season int, balls int, strikes int, career_velo_bucket int, d30_velo_bucket int, d90_velo_bucket int, mean_speed double, var_speed double, n long, pitch_of_pa int")
    spec = M.MarketSpec("pitch_speed_ou", "linear", lambda: None, features=("balls", "strikes", "pitcher_velo"), bucket="velo_bucket", base=92.8, step=0.5)
    p = M.fit_linear(cells, spec, "career")
    assert p["coef"] == pytest.approx([1, -1, 1], abs=1e-4) and p["sigma"] == pytest.approx(2, abs=1e-3)
    assert M.sigma_coverage(cells, F.col("mean_speed"), 2.0).first()["coverage"] == pytest.approx(0.6827, abs=1e-3)


def test_remaining_table_and_home_advantage(spark):
    cells = spark.createDataFrame([(2016, 0, 0, 3, 1), (2016, 0, 0, 5, 1)], "season int, balls int, strikes int, remaining int, n long")
    r = M.remaining_table(cells).first()
    assert r["mean"] == 4.0 and r["dist"] == {3: 0.5, 5: 0.5}
    games = spark.createDataFrame([(2015, 1, 10), (2016, 1, 10), (2016, 0, 10)], "season int, home_win int, n long")
    assert M.home_advantage(games).first()[0] == pytest.approx(2 / 3, abs=1e-6)
    assert M.home_advantage(games, half_life=1).first()[0] == pytest.approx(15 / 25, abs=1e-6)


def test_gate_and_registry(spark):
    assert M.may_promote({"logloss": 1.0}, {"logloss": 0.99}, "logloss")[0]
    assert not M.may_promote({"logloss": 1.05}, {"logloss": 1.0}, "logloss")[0]
    assert not M.may_promote({"rmse": 1.0, "coverage": 0.8}, None, "rmse")[0]
    reg = spark.createDataFrame([("m", "v1", True, None), ("m", "v2", False, None), ("k", "v1", True, None)], "market string, version string, is_active boolean, activated_at timestamp")
    now = M.activate(M.activate(reg, "m", "v1", F.lit("2026-01-01")), "m", "v2", F.lit("2026-02-01"))
    assert sorted((r["market"], r["version"]) for r in now.where("is_active").collect()) == [("k", "v1"), ("m", "v2")]
    assert M.rollback_target(now).collect()[0]["version"] == "v1"
    assert M.activate(reg, "m", "v9", F.lit("2026-01-01")).where("is_active").count() == 2
    with pytest.raises(ValueError):
        M.MarketSpec("x", "tree", lambda: None)
    assert SPEC.digest != M.MarketSpec("pitch_result", "multinomial", lambda: None, features=("balls",), classes=SPEC.classes).digest


def test_rebuilt_fits_refuse_what_is_incomplete():
    good = {"type": "multinomial_logistic", "classes": ["a", "b"], "features": ["balls"], "coef": [[1.0], [2.0]], "intercept": [0.0, 1.0]}
    assert M.rebuilt(json.dumps(good)) == good
    assert M.rebuilt({"type": "log5", "home_adv": 0.54})["home_adv"] == 0.54
    for bad in ({}, {"type": "linear", "features": ["balls"], "coef": [1.0], "intercept": 0.0}, good | {"coef": [[1.0]]}, good | {"features": ["balls", "strikes"]}, good | {"coef": None}, {"type": "remaining_table", "table": {}}):
        with pytest.raises(ValueError):
            M.rebuilt(bad)


def test_design_refuses_a_feature_that_cells_lack(spark):
    spec = M.MarketSpec("x", "multinomial", lambda: None, ("pitch_of_pa",), ("a",))
    with pytest.raises(ValueError):
        M.design(spark.createDataFrame([(0, 0, 1)], "balls int, strikes int, career_zone_bucket int"), spec, "career")


def test_run_log_and_best_setting(spark):
    spec = M.MarketSpec("x", "log5", lambda: None)
    runs = spark.createDataFrame([], "market string, spec_hash string, setting string, metrics string, holdout boolean, finished_at timestamp")
    runs = M.logged_run(M.logged_run(runs, spec, {"h": "1"}, {"logloss": 0.6}, F.lit("2024-01-01")), spec, {"h": "2"}, {"logloss": 0.5}, F.lit("2024-01-02"), True)
    assert runs.where("holdout").count() == 1 and runs.select("spec_hash").distinct().first()[0] == spec.digest
    results = spark.createDataFrame([(1.0, 0.6), (2.0, 0.5), (4.0, 0.5), (8.0, None)], "half_life double, logloss double")
    assert M.best_setting(results, "logloss").first()["half_life"] == 2.0 and M.best_setting(results, "logloss", True).first()["half_life"] == 1.0
    with pytest.raises(ValueError):
        M.best_setting(results, "rmse")
