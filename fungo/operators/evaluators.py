"""Stored fits scored on cells: every fit and every season at once, by the evaluator of its family.

A fit is a row (arrays of names and coefficients), so scoring is a join of cells
with fits of the same market and arithmetic on arrays; the plan does not grow
with the number of fits or seasons.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators.models import NEEDED, MarketSpec, rebuilt

#: Fits that are handed to every task; more of them raise.
MOST_FITS, BINS, EPS = 10_000, 10, 1e-12
FITS = "fit_id string, market string, type string, form_window string, classes array<string>, features array<string>, coef array<array<double>>, intercept array<double>, sigma double, dist map<string,double>, home_adv double"
METRICS = "fit_id string, season int, metric string, value double, n double"


def stored_fits(spark: SparkSession, rows: Sequence[tuple[str, str, str | Mapping]]) -> DataFrame:
    """Rows of (fit id, market, stored parameters); parameters that cannot be scored raise."""
    out = []
    for fit_id, market, params in rows:
        p = rebuilt(params)
        many = p["type"] == "multinomial_logistic"
        coef = p.get("coef") or []
        base = p.get("intercept")
        dist = {f"{state}|{k}": float(v) for state, entry in (p.get("table") or {}).items() for k, v in entry["dist"].items()}
        out.append((fit_id, market, p["type"], p.get("form_window"), p.get("classes"), p.get("features"), coef if many else [coef] if coef else None, (base if many else [base]) if base is not None else None, p.get("sigma"), dist or None, p.get("home_adv")))
    return spark.createDataFrame(out, FITS)


def _known(spec: MarketSpec) -> dict[str, Column]:
    """Inputs of a cell by name; the form is that of the fit's own window."""
    form = F.element_at(F.create_map(*(x for w in spec.windows for x in (F.lit(w), F.col(f"{w}_{spec.bucket}").cast("double")))), F.col("form_window")) * spec.step
    return {"balls": F.col("balls"), "strikes": F.col("strikes"), "two_strikes": (F.col("strikes") >= 2).cast("int"), "three_balls": (F.col("balls") >= 3).cast("int"), "pitcher_zone_delta": form, "pitcher_k_delta": form, "pitcher_velo": spec.base + form}


def scores(spec: MarketSpec, has_pitch_of_pa: bool = False) -> tuple[Column, Column, Column]:
    """Inputs of a cell as a map, those that the fit names as an array, and a score for each row of coefficients; a feature that cells lack raises."""
    known = _known(spec) | ({"pitch_of_pa": F.col("pitch_of_pa")} if has_pitch_of_pa else {})
    inputs = F.create_map(*(x for k, c in known.items() for x in (F.lit(k), c.cast("double"))))
    value = lambda f: F.coalesce(F.try_element_at(F.col("__inputs"), f), F.when(F.array_contains(F.map_keys(F.col("__inputs")), f), F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit("cells carry no feature "), f)).cast("double")))
    x = F.transform("features", value)
    dot = lambda row, b: F.aggregate(F.zip_with(row, F.col("__x"), lambda w, v: w * v), b, lambda a, v: a + v)
    return inputs, x, F.zip_with("coef", "intercept", dot)


def _with_scores(cells: DataFrame, fits: DataFrame, spec: MarketSpec) -> DataFrame:
    inputs, x, z = scores(spec, "pitch_of_pa" in cells.columns)
    joined = cells.join(F.broadcast(fits))  # fits are few: see scored()
    return joined.withColumn("__inputs", inputs).withColumn("__x", x).withColumn("__z", z)


def _long(g: DataFrame, metrics: Mapping[str, Column]) -> DataFrame:
    """Metrics as rows."""
    parts = F.array(*(F.struct(F.lit(k).alias("metric"), c.cast("double").alias("value")) for k, c in metrics.items()))
    return g.select("fit_id", F.col("season").cast("int").alias("season"), F.explode(parts).alias("m"), F.col("n").cast("double").alias("n")).select("fit_id", "season", "m.metric", "m.value", "n")


def multinomial(cells: DataFrame, fits: DataFrame, spec: MarketSpec) -> DataFrame:
    """Log loss, Brier score and calibration error of the second class, in ten bins."""
    s = _with_scores(cells, fits, spec).withColumn("__e", F.transform("__z", lambda z: F.exp(z - F.array_max("__z"))))
    s = s.withColumn("__p", F.transform("__e", lambda e: e / F.aggregate("__e", F.lit(0.0), lambda a, v: a + v)))
    s = s.withColumn("__y", F.array_position("classes", F.col("outcome")).cast("int")).where("__y > 0")
    n = F.col("n").cast("double")
    own = F.element_at("__p", F.col("__y"))
    brier = F.aggregate(F.transform("__p", lambda p, i: F.pow(p - (i + 1 == F.col("__y")).cast("int"), 2)), F.lit(0.0), lambda a, v: a + v)
    second = F.element_at("__p", 2)
    b = s.select("fit_id", "season", n.alias("n"), (-n * F.log(F.greatest(own, F.lit(EPS)))).alias("loss"), (n * brier).alias("brier"), F.least(F.lit(BINS - 1), F.floor(second * BINS)).alias("bin"), (n * second).alias("said"), (n * (F.col("__y") == 2).cast("int")).alias("hit"))
    bins = b.groupBy("fit_id", "season", "bin").agg(*(F.sum(c).alias(c) for c in ("n", "loss", "brier", "said", "hit")))
    gap = F.sum(F.abs(F.round(F.col("said") / F.col("n"), 5) - F.round(F.col("hit") / F.col("n"), 5)) * F.col("n"))
    g = bins.groupBy("fit_id", "season").agg(F.sum("loss").alias("loss"), F.sum("brier").alias("brier"), gap.alias("gap"), F.sum("n").alias("n"))
    return _long(g, {"logloss": F.round(F.col("loss") / F.col("n"), 6), "brier": F.round(F.col("brier") / F.col("n"), 6), "ece": F.round(F.col("gap") / F.col("n"), 6)})


def linear(cells: DataFrame, fits: DataFrame, spec: MarketSpec) -> DataFrame:
    """Error of cell means, the fit's deviation, and the share of events within it."""
    s = _with_scores(cells, fits, spec).withColumn("__mu", F.element_at("__z", 1))
    n, miss = F.col("n").cast("double"), F.col("mean_speed") - F.col("__mu")
    sd = F.sqrt(F.greatest(F.coalesce("var_speed", F.lit(0.0)), F.lit(EPS)))
    inside = P.normal_cdf((F.col("sigma") - miss) / sd) - P.normal_cdf((-F.col("sigma") - miss) / sd)
    g = s.groupBy("fit_id", "season").agg(F.sum(n * miss * miss).alias("sq"), F.sum(n * inside).alias("inside"), F.max("sigma").alias("sigma"), F.sum(n).alias("n"))
    return _long(g, {"rmse": F.round(F.sqrt(F.col("sq") / F.col("n")), 6), "sigma": F.round("sigma", 4), "sigma_coverage": F.round(F.col("inside") / F.col("n"), 5)})


def remaining_table(cells: DataFrame, fits: DataFrame, spec: MarketSpec) -> DataFrame:
    """Log loss of the stored distribution of each count; a count or number it lacks has no chance."""
    key = F.concat(F.concat_ws("-", F.col("balls").cast("int").cast("string"), F.col("strikes").cast("int").cast("string")), F.lit("|"), F.col("remaining").cast("int").cast("string"))
    p = F.least(F.lit(1.0), F.greatest(F.lit(EPS), F.coalesce(F.try_element_at("dist", key), F.lit(0.0))))
    n = F.col("n").cast("double")
    states = F.size(F.array_distinct(F.transform(F.map_keys("dist"), lambda k: F.substring_index(k, "|", 1))))
    g = cells.join(F.broadcast(fits)).groupBy("fit_id", "season").agg(F.sum(-n * F.log(p)).alias("loss"), F.max(states).alias("states"), F.sum(n).alias("n"))
    return _long(g, {"logloss": F.round(F.col("loss") / F.col("n"), 6), "states": F.col("states")})


def log5(cells: DataFrame, fits: DataFrame, spec: MarketSpec) -> DataFrame:
    """Brier score of the stored home chance."""
    n = F.col("n").cast("double")
    g = cells.join(F.broadcast(fits)).groupBy("fit_id", "season").agg(F.sum(n * F.pow(F.col("home_adv") - F.col("home_win"), 2)).alias("sq"), F.max("home_adv").alias("home_adv"), F.sum(n).alias("n"))
    return _long(g, {"brier": F.round(F.col("sq") / F.col("n"), 6), "home_adv": F.round("home_adv", 4)})


Evaluator = Callable[[DataFrame, DataFrame, MarketSpec], DataFrame]
EVALUATORS: dict[str, Evaluator] = {"multinomial": multinomial, "linear": linear, "remaining": remaining_table, "log5": log5}
TYPE_OF = {"multinomial": "multinomial_logistic", "linear": "linear", "remaining": "remaining_table", "log5": "log5"}
assert set(TYPE_OF.values()) == set(NEEDED)


def scored(cells: DataFrame, fits: DataFrame, spec: MarketSpec, seasons: Sequence[int] | None = None) -> DataFrame:
    """(fit_id, season, metric, value, n): all stored fits of the market on every season, none refitted.

    A family without an evaluator raises, and so do more than MOST_FITS fits, as
    they are handed to every task. Fits of another type than the market's are left out.
    """
    if spec.family not in EVALUATORS:
        raise NotImplementedError(f"no evaluator for family {spec.family} (market {spec.market})")
    own = fits.where((F.col("market") == spec.market) & (F.col("type") == TYPE_OF[spec.family]))
    if own.limit(MOST_FITS + 1).count() > MOST_FITS:
        raise ValueError(f"more than {MOST_FITS} fits of {spec.market}")
    held = cells if seasons is None else cells.where(F.col("season").isin(list(seasons)))
    return EVALUATORS[spec.family](held, own, spec)


def fold_means(scores: DataFrame, skip: Sequence[int] = (), digits: int = 6) -> DataFrame:
    """Means over seasons weighted by their events, with the seasons used and left out."""
    out = F.col("season").isin(list(skip)) if skip else F.lit(False)
    n = F.sum(F.when(~out, F.col("n")))
    return scores.groupBy("fit_id", "metric").agg(
        F.round(F.sum(F.when(~out, F.col("value") * F.col("n"))) / n, digits).alias("value"), F.count_if(~out).cast("int").alias("folds_used"), F.count_if(out).cast("int").alias("folds_excluded"), n.alias("n")
    ).where("folds_used > 0")


def baseline(cells: DataFrame, registry: DataFrame, spec: MarketSpec, seasons: Sequence[int] | None = None, skip: Sequence[int] = ()) -> DataFrame:
    """Out-of-sample figures of the market's active version, by its stored parameters; no row if none is active.

    ``registry``: market, version, is_active, params (JSON). Parameters that cannot be scored raise.
    """
    active = registry.where((F.col("market") == spec.market) & F.col("is_active")).select("version", "params").limit(MOST_FITS).collect()  # at most one by rule
    fits = stored_fits(cells.sparkSession, [(r["version"], spec.market, json.loads(r["params"])) for r in active])
    return fold_means(scored(cells, fits, spec, seasons), skip)
