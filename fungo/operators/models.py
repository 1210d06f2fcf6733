"""Fitting, checking and promoting models on weighted cells."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions import predicates as P

# The penalty, the band that coverage must fall in, and how much worse a candidate may be.
INVERSE_PENALTY, COVERAGE_BAND, TOLERANCE = 10.0, (0.63, 0.73), 0.02


@dataclass(frozen=True)
class MarketSpec:
    """What a market is fitted from. ``cells`` builds the weighted cells."""

    market: str
    family: str  # multinomial, linear, remaining or log5
    cells: Callable[..., DataFrame]
    features: tuple[str, ...] = ()
    classes: tuple[str, ...] = ()
    windows: tuple[str, ...] = ("career", "d30", "d90")
    bucket: str = "zone_bucket"
    base: float = 0.0
    step: float = 1.0
    metric: str = "logloss"
    extra: Mapping = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.family not in ("multinomial", "linear", "remaining", "log5"):
            raise ValueError(f"unknown family {self.family}")

    @property
    def digest(self) -> str:
        """Changes with every setting of the spec."""
        return hashlib.sha256(json.dumps([self.market, self.family, self.features, self.classes, self.windows, self.bucket, self.base, self.step, self.metric, dict(self.extra)]).encode()).hexdigest()[:16]


def decayed(cells: DataFrame, last_season: int, half_life: float | None) -> DataFrame:
    """Cells with weight n halved for every ``half_life`` seasons of age."""
    w = F.col("n").cast("double")
    return cells.withColumn("weight", w * F.pow(F.lit(0.5), (last_season - F.col("season")) / half_life) if half_life else w)


def design(cells: DataFrame, spec: MarketSpec, window: str) -> DataFrame:
    """Model inputs from a cell: the form at the bucket's edge less the base, and the count."""
    form = F.col(f"{window}_{spec.bucket}") * spec.step
    inputs: dict[str, Column] = {"balls": F.col("balls"), "strikes": F.col("strikes"), "two_strikes": (F.col("strikes") >= 2).cast("int"), "three_balls": (F.col("balls") >= 3).cast("int"), "pitcher_zone_delta": form, "pitcher_k_delta": form, "pitcher_velo": spec.base + form}
    if "pitch_of_pa" in cells.columns:
        inputs["pitch_of_pa"] = F.col("pitch_of_pa")
    if unknown := [f for f in spec.features if f not in inputs]:
        raise ValueError(f"cells carry no feature {unknown}")
    return cells.withColumns({f"x_{f}": inputs[f].cast("double") for f in spec.features})


def _vectors(df: DataFrame, spec: MarketSpec) -> DataFrame:
    return VectorAssembler(inputCols=[f"x_{f}" for f in spec.features], outputCol="x").transform(df)


def fit_multinomial(cells: DataFrame, spec: MarketSpec, window: str, half_life: float | None = None, last_season: int | None = None, outcome: str = "outcome") -> dict:
    """Weighted multinomial logistic fit: one row of coefficients a class."""
    last = last_season if last_season is not None else cells.agg(F.max("season")).first()[0]
    data = design(decayed(cells.where(F.col(outcome).isin(*spec.classes)), last, half_life), spec, window)
    label = F.element_at(F.create_map(*(F.lit(x) for i, c in enumerate(spec.classes) for x in (c, float(i)))), F.col(outcome))
    data = _vectors(data.withColumn("label", label), spec)
    total = data.agg(F.sum("weight")).first()[0]
    if not total:
        raise ValueError("no cells to fit on")
    m = LogisticRegression(featuresCol="x", labelCol="label", weightCol="weight", family="multinomial", standardization=False, regParam=1.0 / (INVERSE_PENALTY * total), maxIter=200, tol=1e-8).fit(data)
    return {"type": "multinomial_logistic", "classes": list(spec.classes), "features": list(spec.features), "coef": m.coefficientMatrix.toArray().round(6).tolist(), "intercept": m.interceptVector.toArray().round(6).tolist(), "form_window": window}


def fit_linear(cells: DataFrame, spec: MarketSpec, window: str, half_life: float | None = None, last_season: int | None = None) -> dict:
    """Weighted least squares on cell means, with a deviation from variance between and within cells."""
    last = last_season if last_season is not None else cells.agg(F.max("season")).first()[0]
    data = _vectors(design(decayed(cells, last, half_life), spec, window), spec).persist()
    try:
        m = LinearRegression(featuresCol="x", labelCol="mean_speed", weightCol="weight", solver="normal").fit(data)
        out = m.transform(data)
        var = F.sum(F.col("weight") * (F.pow(F.col("mean_speed") - F.col("prediction"), 2) + F.col("var_speed"))) / F.sum("weight")
        sigma = out.agg(F.sqrt(var)).first()[0]
    finally:
        data.unpersist()
    return {"type": "linear", "features": list(spec.features), "coef": [round(float(c), 6) for c in m.coefficients], "intercept": round(float(m.intercept), 6), "sigma": round(float(sigma), 4), "form_window": window}


def remaining_table(cells: DataFrame, half_life: float | None = None, last_season: int | None = None) -> DataFrame:
    """Distribution and mean of the pitches to come in each count."""
    last = F.lit(last_season) if last_season is not None else F.lit(cells.agg(F.max("season")).first()[0])
    w = F.col("n") * (F.pow(F.lit(0.5), (last - F.col("season")) / half_life) if half_life else F.lit(1.0))
    g = cells.groupBy("balls", "strikes", "remaining").agg(F.sum(w).alias("w"))
    t = g.groupBy("balls", "strikes").agg(F.sum("w").alias("total"), F.sum(F.col("w") * F.col("remaining")).alias("wr"), F.array_sort(F.collect_list(F.struct("remaining", "w"))).alias("d"))
    return t.select("balls", "strikes", F.round(F.col("wr") / F.col("total"), 6).alias("mean"), F.map_from_entries(F.transform("d", lambda x: F.struct(x["remaining"], F.round(x["w"] / F.col("total"), 6)))).alias("dist"))


def home_advantage(cells: DataFrame, half_life: float | None = None, last_season: int | None = None) -> DataFrame:
    """Weighted share of home wins."""
    last = F.lit(last_season) if last_season is not None else F.lit(cells.agg(F.max("season")).first()[0])
    w = F.col("n") * (F.pow(F.lit(0.5), (last - F.col("season")) / half_life) if half_life else F.lit(1.0))
    return cells.agg(F.round(F.sum(w * F.col("home_win")) / F.sum(w), 6).alias("home_adv"))


def predict_multinomial(cells: DataFrame, params: Mapping, spec: MarketSpec) -> DataFrame:
    """Cells with p_<class>: softmax of literal coefficients."""
    data = design(cells, spec, params["form_window"])
    z = {c: sum((w * F.col(f"x_{f}") for f, w in zip(params["features"], row, strict=True)), F.lit(b)) for c, row, b in zip(params["classes"], params["coef"], params["intercept"], strict=True)}
    most = F.greatest(*z.values())
    e = {c: F.exp(x - most) for c, x in z.items()}
    total = sum(e.values(), F.lit(0.0))
    return data.withColumns({f"p_{c}": x / total for c, x in e.items()})


def class_metrics(scored: DataFrame, classes: Sequence[str], weight: str = "n", outcome: str = "outcome") -> DataFrame:
    """Weighted log loss and Brier score."""
    w = F.col(weight).cast("double")
    p = F.coalesce(*(F.when(F.col(outcome) == c, F.col(f"p_{c}")) for c in classes))
    brier = sum((F.pow(F.col(f"p_{c}") - (F.col(outcome) == c).cast("int"), 2) for c in classes), F.lit(0.0))
    return scored.agg(F.round(F.sum(-w * F.log(F.greatest(p, F.lit(1e-12)))) / F.sum(w), 6).alias("logloss"), F.round(F.sum(w * brier) / F.sum(w), 6).alias("brier"), F.sum(weight).alias("n"))


def calibration(scored: DataFrame, prob: str, hit: Column, weight: str = "n", bins: int = 10) -> DataFrame:
    """Mean chance against share of hits in equal bins; the last bin holds 1 itself."""
    w = F.col(weight).cast("double")
    b = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.round(F.sum(w * F.col(prob)) / F.sum(w), 6).alias("mean_prob"), F.round(F.sum(w * hit.cast("int")) / F.sum(w), 6).alias("hit_rate"), F.sum(weight).alias("n"))


def calibration_error(bins: DataFrame) -> DataFrame:
    """Mean gap of the bins, weighted by their size."""
    return bins.agg(F.round(F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("hit_rate"))) / F.sum("n"), 6).alias("ece"))


def sigma_coverage(cells: DataFrame, mu: Column, sigma: float, weight: str = "n") -> DataFrame:
    """Share of events within one deviation of the prediction, from cells: each holds a normal spread about its mean."""
    s = F.sqrt(F.greatest(F.col("var_speed"), F.lit(1e-9)))
    inside = P.normal_cdf((mu + sigma - F.col("mean_speed")) / s) - P.normal_cdf((mu - sigma - F.col("mean_speed")) / s)
    return cells.agg(F.round(F.sum(F.col(weight) * inside) / F.sum(weight), 6).alias("coverage"))


def walk_forward(cells: DataFrame, fit: Callable[[DataFrame, int], Mapping], evaluate: Callable[[DataFrame, Mapping], DataFrame], seasons: Sequence[int]) -> DataFrame:
    """Each season scored by a fit on the seasons before it. Cells are small; the loop is over seasons."""
    out = None
    for s in seasons:
        params = fit(cells.where(F.col("season") < s), s)
        r = evaluate(cells.where(F.col("season") == s), params).withColumn("season", F.lit(s))
        out = r if out is None else out.unionByName(r)
    if out is None:
        raise ValueError("no seasons to walk through")
    return out


def fold_mean(folds: DataFrame, metrics: Sequence[str], skip: Sequence[int] = ()) -> DataFrame:
    """Means over folds weighted by their events, without the listed seasons."""
    f = folds.where(~F.col("season").isin(*skip)) if skip else folds
    return f.agg(*(F.round(F.sum(F.col(m) * F.col("n")) / F.sum("n"), 6).alias(m) for m in metrics), F.sum("n").alias("n"))


def may_promote(candidate: Mapping[str, float], incumbent: Mapping[str, float] | None, metric: str) -> tuple[bool, str]:
    """Whether a candidate is good enough: not over 2 % worse, and coverage inside its band where it has one."""
    cover = candidate.get("coverage")
    if cover is not None and not COVERAGE_BAND[0] <= cover <= COVERAGE_BAND[1]:
        return False, f"coverage {cover:.3f} outside {COVERAGE_BAND}"
    if incumbent is None or metric not in incumbent:
        return True, "no incumbent"
    if candidate[metric] > incumbent[metric] * (1 + TOLERANCE):
        return False, f"{metric} {candidate[metric]:.4f} worse than {incumbent[metric]:.4f}"
    return True, "within tolerance"


def activate(registry: DataFrame, market: str, version: str, at: Column) -> DataFrame:
    """The registry with exactly this version active in its market. An unknown version leaves the market as it is."""
    known = registry.where((F.col("market") == market) & (F.col("version") == version)).agg(F.count("*").alias("__k"))
    mine, chosen = F.col("market") == market, F.col("version") == version
    r = registry.join(F.broadcast(known))
    now = F.when(mine & (F.col("__k") > 0), chosen).otherwise(F.col("is_active"))
    return r.withColumns({"activated_at": F.when(mine & chosen & (F.col("__k") > 0), at.cast("timestamp")).otherwise(F.col("activated_at")), "is_active": now}).drop("__k")


def rollback_target(registry: DataFrame) -> DataFrame:
    """For each market the version that was active before the present one."""
    return registry.where("not is_active and activated_at is not null").groupBy("market").agg(F.max_by("version", F.struct("activated_at", "version")).alias("version"))


def row_coverage(events: DataFrame, actual: Column, mu: Column, sigma: float, digits: int = 6) -> DataFrame:
    """Share of events within one deviation of their prediction, event by event."""
    inside = (F.abs(actual - mu) <= sigma).cast("int")
    return events.where(actual.isNotNull()).agg(F.round(F.avg(inside), digits).alias("coverage"), F.count("*").alias("n"))


def home_advantage_folds(cells: DataFrame, half_lives: Sequence[float | None], first: int, skip: Sequence[int] = ()) -> DataFrame:
    """Every half-life's out-of-sample log loss and Brier score of a constant home chance, season by season.

    All folds and half-lives come from one pass: a cell of season s trains every
    fold after s. Cells are one row a season and outcome, so the fan-out is small.
    """
    seasons = cells.select(F.col("season").alias("fold")).distinct().where(F.col("fold") >= first)
    seasons = seasons.where(~F.col("fold").isin(*skip)) if skip else seasons
    halves = F.explode(F.array(*(F.lit(h).cast("double") for h in half_lives)))
    # at most one row for each season
    tried = F.broadcast(seasons.withColumn("half_life", halves))
    train = cells.join(tried, F.col("season") < F.col("fold"))
    w = F.col("n") * F.when(F.col("half_life").isNull(), 1.0).otherwise(F.pow(F.lit(0.5), (F.col("fold") - 1 - F.col("season")) / F.col("half_life")))
    fitted = train.groupBy("fold", "half_life").agg(F.round(F.sum(w * F.col("home_win")) / F.sum(w), 6).alias("home_adv"))
    test = fitted.join(cells, F.col("season") == F.col("fold"))
    p = F.when(F.col("home_win") == 1, F.col("home_adv")).otherwise(1 - F.col("home_adv"))
    return test.groupBy("fold", "half_life", "home_adv").agg(
        F.round(F.sum(-F.col("n") * F.log(F.greatest(p, F.lit(1e-12)))) / F.sum("n"), 6).alias("logloss"),
        F.round(F.sum(F.col("n") * F.pow(1 - p, 2)) / F.sum("n"), 6).alias("brier"),
        F.sum("n").alias("n"),
    )


def sweep(folds: DataFrame, settings: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Means over folds, weighted by events, for each setting."""
    return folds.groupBy(*settings).agg(*(F.round(F.sum(F.col(m) * F.col("n")) / F.sum("n"), 6).alias(m) for m in metrics), F.count("*").alias("folds_used"), F.sum("n").alias("n"))


def best_setting(results: DataFrame, metric: str, higher: bool = False) -> DataFrame:
    """The row of the best metric; ties go to the setting first in order. Raises if nothing carries the metric."""
    if metric not in results.columns:
        raise ValueError(f"no sweep result carries {metric}")
    key = F.struct(-F.col(metric) if higher else F.col(metric), *(c for c in results.columns if c != metric))
    return results.where(F.col(metric).isNotNull()).agg(F.min_by(F.struct(*results.columns), key).alias("r")).where("r is not null").select("r.*")


#: What a stored fit must hold, by type.
NEEDED = {"multinomial_logistic": ("classes", "features", "coef", "intercept"), "linear": ("features", "coef", "intercept", "sigma"), "remaining_table": ("table",), "log5": ("home_adv",)}


def rebuilt(params: str | Mapping) -> dict:
    """A stored fit, checked: incomplete or uneven parameters raise instead of scoring as something else."""
    p = dict(json.loads(params) if isinstance(params, str) else params)
    kind = p.get("type")
    if kind not in NEEDED:
        raise ValueError(f"unknown type of fit: {kind}")
    if missing := [k for k in NEEDED[kind] if p.get(k) in (None, [], {})]:
        raise ValueError(f"incomplete fit: {', '.join(missing)} missing")
    if kind == "multinomial_logistic" and not (len(p["classes"]) == len(p["coef"]) == len(p["intercept"]) and all(len(row) == len(p["features"]) for row in p["coef"])):
        raise ValueError("coefficients do not fit classes and features")
    if kind == "linear" and len(p["coef"]) != len(p["features"]):
        raise ValueError("coefficients do not fit features")
    return p


def logged_run(runs: DataFrame, spec: MarketSpec, setting: Mapping[str, str], metrics: Mapping[str, float], at: Column, holdout: bool = False) -> DataFrame:
    """The run log with one more row: market, spec hash, setting, metrics, holdout or not, time."""
    one = runs.sparkSession.range(1).select(
        F.lit(spec.market).alias("market"), F.lit(spec.digest).alias("spec_hash"), F.lit(json.dumps(dict(setting), sort_keys=True)).alias("setting"),
        F.lit(json.dumps(dict(metrics), sort_keys=True)).alias("metrics"), F.lit(holdout).alias("holdout"), at.cast("timestamp").alias("finished_at"),
    )
    return runs.unionByName(one)


def version_drift(registry: DataFrame, stamped: DataFrame) -> DataFrame:
    """Markets whose newest calls carry another version than the active one, or none."""
    active = registry.where("is_active").select("market", F.col("version").alias("active_version"))
    last = stamped.groupBy("market").agg(F.max_by("model_version", F.struct("created_date", "id")).alias("stamped_version"))
    both = active.join(last, "market", "full")
    return both.withColumn("drifted", ~F.col("active_version").eqNullSafe(F.col("stamped_version")))
