"""Training a market: every setting walked forward, the best held out and fitted anew on everything, and the gate."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.operators import evaluators as V
from fungo.operators import models as M

# Half-lives in seasons that are tried.
HALF_LIVES: tuple[float | None, ...] = (None, 1.0, 2.0, 4.0)

Fit = Callable[[DataFrame, M.MarketSpec, str, float | None], dict]


def _table(cells: DataFrame, spec: M.MarketSpec, window: str, half_life: float | None) -> dict:
    rows = M.remaining_table(cells, half_life).collect()  # a row a count
    return {"type": "remaining_table", "table": {f"{r['balls']}-{r['strikes']}": {"mean": r["mean"], "dist": {str(k): v for k, v in r["dist"].items()}} for r in rows}, "form_window": window}


def _home(cells: DataFrame, spec: M.MarketSpec, window: str, half_life: float | None) -> dict:
    return {"type": "log5", "home_adv": M.home_advantage(cells, half_life).first()[0], "form_window": window}


FITS: dict[str, Fit] = {"multinomial": M.fit_multinomial, "linear": M.fit_linear, "remaining": _table, "log5": _home}


def fitted(cells: DataFrame, spec: M.MarketSpec, window: str, half_life: float | None) -> dict:
    """Parameters of the spec's family on these cells. An unknown family raises."""
    if spec.family not in FITS:
        raise NotImplementedError(f"no fit for family {spec.family}")
    return FITS[spec.family](cells, spec, window, half_life)


def sweep(cells: DataFrame, spec: M.MarketSpec, seasons: Sequence[int], half_lives: Sequence[float | None] = HALF_LIVES, skip: Sequence[int] = ()) -> DataFrame:
    """(form_window, half_life, metric, value, folds_used, folds_excluded, n): means over seasons, each scored by a fit on those before it.

    Cells are read once for each fit, as a fit is one Spark job; all fits are
    scored together in one pass, and of its scores those of each fit's own season count.
    """
    years = {r[0] for r in cells.select("season").distinct().collect()}
    folds = [s for s in seasons if s in years and any(y < s for y in years)]
    settings = [(w, h) for w in spec.windows for h in half_lives]
    rows = [(f"{i}|{s}", spec.market, fitted(cells.where(F.col("season") < s), spec, w, h)) for i, (w, h) in enumerate(settings) for s in folds]
    if not rows:
        raise ValueError(f"{spec.market}: no season has cells before it")
    scored = V.scored(cells, V.stored_fits(cells.sparkSession, rows), spec, folds)
    setting, season = F.split_part("fit_id", F.lit("|"), F.lit(1)), F.split_part("fit_id", F.lit("|"), F.lit(2)).cast("int")
    own = scored.where(F.col("season") == season).withColumn("fit_id", setting)
    names = cells.sparkSession.createDataFrame([(str(i), w, h) for i, (w, h) in enumerate(settings)], "fit_id string, form_window string, half_life double")
    return V.fold_means(own, skip).join(F.broadcast(names), "fit_id").drop("fit_id")  # a row a setting


@dataclass(frozen=True)
class Trained:
    """What training a market gave."""

    form_window: str
    half_life: float | None
    out_of_sample: Mapping[str, float]
    holdout: Mapping[str, float] | None
    params: Mapping
    promote: bool
    reason: str


def _figures(scores: DataFrame) -> dict[str, float]:
    return {r["metric"]: r["value"] for r in scores.collect()}


def train(cells: DataFrame, spec: M.MarketSpec, seasons: Sequence[int], holdout: int, half_lives: Sequence[float | None] = HALF_LIVES, skip: Sequence[int] = (), incumbent: Mapping[str, float] | None = None, higher: bool = False) -> Trained:
    """The best setting by the spec's metric (ties: the first), its figures on the held-out season, and parameters fitted on all seasons.

    The sweep and the held-out fit do not see the held-out season; the shipped
    parameters do. Without cells of that season there are no held-out figures.
    ``incumbent`` holds the active version's out-of-sample figures.
    """
    before = cells.where(F.col("season") < holdout)
    found = sweep(before, spec, [s for s in seasons if s < holdout], half_lives, skip).collect()
    results: dict[tuple, dict[str, float]] = {}
    for r in found:
        results.setdefault((r["form_window"], r["half_life"]), {})[r["metric"]] = r["value"]
    order = {(w, h): i for i, (w, h) in enumerate((w, h) for w in spec.windows for h in half_lives)}
    ranked = sorted((s for s in results if spec.metric in results[s]), key=lambda s: (-results[s][spec.metric] if higher else results[s][spec.metric], order[s]))
    if not ranked:
        raise ValueError(f"{spec.market}: no result carries {spec.metric}")
    window, half_life = ranked[0]
    held = cells.where(F.col("season") == holdout)
    check = None
    if not held.isEmpty():
        fits = V.stored_fits(cells.sparkSession, [("held", spec.market, fitted(before, spec, window, half_life))])
        check = _figures(V.scored(held, fits, spec))
    params = fitted(cells, spec, window, half_life)
    figures = results[window, half_life]
    gate = dict(figures) | ({"coverage": figures["sigma_coverage"]} if "sigma_coverage" in figures else {})
    promote, reason = M.may_promote(gate, incumbent, spec.metric)
    return Trained(window, half_life, figures, check, params, promote, reason)


def inserted(registry: DataFrame, market: str, version: str, params: str, metrics: str) -> DataFrame:
    """The registry (market, version, params, metrics, is_active, activated_at) with one more version, not active. A version that is there raises."""
    if registry.where((F.col("market") == market) & (F.col("version") == version)).limit(1).count():
        raise ValueError(f"{market} has a version {version}")
    one = registry.sparkSession.createDataFrame([(market, version, params, metrics, False, None)], registry.select("market", "version", "params", "metrics", "is_active", "activated_at").schema)
    return registry.unionByName(one)


def rolled_back(registry: DataFrame, market: str, at) -> DataFrame:
    """The registry with the market's version before the present one active again. Raises if there is none."""
    target = M.rollback_target(registry).where(F.col("market") == market).first()
    if target is None:
        raise ValueError(f"{market} has no earlier version")
    return M.activate(registry, market, target["version"], at)
