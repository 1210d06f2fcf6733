"""Predictors from frequencies alone: each figure shrunk to the league's row by row, with the list of inputs that were at hand.

A context row has balls, strikes, pitch_count_pa, pitch_hand and bat_side, and
whatever is known of the players; a missing input is null and leaves its step out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators.pricing import COUNT_SHIFTS, LEAGUE_PA, LEAGUE_PITCH, LEAGUE_PITCHES, LEAGUE_SPEED

# Shrinkage, confidence, what counts do, and the rates from which a player moves the chances.
VERSION, BLEND_N = "freq_v2", 500.0
CONFIDENCE_N = {"pitch_speed_ou": 300.0, "pitch_result": 400.0, "ab_result": 150.0, "ab_pitches_ou": 150.0}
SPEED_SHIFTS = {(3, 0): 0.3, (0, 2): -0.4, (1, 2): -0.2}
PA_SHIFTS = {
    (0, 2): {"strikeout": 0.08, "hit": -0.04, "out": -0.04},
    (1, 2): {"strikeout": 0.05, "hit": -0.025, "out": -0.025},
    (3, 0): {"walk": 0.15, "out": -0.08, "hit": -0.05, "strikeout": -0.02},
    (3, 1): {"walk": 0.08, "out": -0.04, "hit": -0.03, "strikeout": -0.01},
    (3, 2): {"strikeout": 0.04, "walk": 0.04, "out": -0.05, "hit": -0.03},
}
ZONE = {"high": 0.55, "low": 0.42, "strike_foul": 0.04, "ball": 0.06}
CHASE = {"high": 0.33, "low": 0.22, "strike_foul": 0.05, "ball": 0.03}
SAME_HAND = {"strikeout": 0.03, "walk": -0.01}
OPPOSITE_HAND = {"strikeout": -0.02, "walk": 0.015}
MATCHUP_PA, MATCHUP_SHARE = 10, 0.3
HARD_HIT, HARD_HIT_MORE, WHIFFER, WHIFFER_MORE = 0.40, 0.03, 0.30, 0.025
FEW_STRIKES, FEW_STRIKES_MORE, PATIENT, PATIENT_MORE = 0.45, 0.4, 0.25, 0.3
FULL_COUNT_TAIL, TWO_STRIKE_TAIL, TAIL = 1.2, 1.3, 1.6

#: Chances while they are worked out; each step is a projection of its own, as every chance enters every other by their sum.
_P, _T = "__p_", "__t_"


def _count(balls: int, strikes: int) -> Column:
    return (F.coalesce("balls", F.lit(0)) == balls) & (F.coalesce("strikes", F.lit(0)) == strikes)


def _normal(df: DataFrame, names: Sequence[str], condition: Column | None = None) -> DataFrame:
    """The changed chances made to add up to one, where the condition holds."""
    total = reduce(lambda a, b: a + b, (F.col(_T + k) for k in names))
    new = {k: F.when(total > 0, F.col(_T + k) / total).otherwise(F.col(_T + k)) for k in names}
    return df.withColumns({_P + k: c if condition is None else F.when(condition, c).otherwise(F.col(_P + k)) for k, c in new.items()})


def _started(df: DataFrame, known: Column, values: Mapping[str, str], league: Mapping[str, float], n: Column) -> DataFrame:
    own = {k: F.when(known, P.blend(F.col(c), league[k], n, BLEND_N)).otherwise(F.lit(league[k])) for k, c in values.items()}
    return _normal(df.withColumns({_T + k: c for k, c in own.items()}), list(values))


def _moved(df: DataFrame, names: Sequence[str], by: Mapping[str, Column | float], condition: Column | None = None) -> DataFrame:
    """Chances moved by amounts, none below zero."""
    new = {k: F.greatest(F.lit(0.0), F.col(_P + k) + by[k]) if k in by else F.col(_P + k) for k in names}
    return _normal(df.withColumns({_T + k: c for k, c in new.items()}), names, condition)


def _at_counts(df: DataFrame, names: Sequence[str], shifts: Mapping[tuple[int, int], Mapping[str, float]]) -> DataFrame:
    by = {k: F.lit(0.0) for k in names}
    any_count = F.lit(False)
    for (b, s), moves in shifts.items():
        any_count = any_count | _count(b, s)
        by = {k: F.when(_count(b, s), moves.get(k, 0.0)).otherwise(c) for k, c in by.items()}
    return _moved(df, names, by, any_count)


def _used(base: Column, **parts: Column) -> Column:
    labels = [F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in parts.items()]
    return F.array_compact(F.array(F.when(base, "pitcher_freq").otherwise("league_avg"), *labels))


def _n(column: str, *more: str) -> Column:
    return reduce(lambda a, b: F.greatest(a, F.coalesce(b, F.lit(0))), more, F.coalesce(column, F.lit(0))).cast("long")


def _row(market: str, n: Column, used: Column, digits: int) -> dict[str, Column]:
    return {"market": F.lit(market), "confidence": F.round(P.confidence(n, CONFIDENCE_N[market]), digits), "sample_size": n, "model_version": F.lit(VERSION), "features_used": used}


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


Made = tuple[DataFrame, dict[str, Column]]


def pitch_speed(ctx: DataFrame, digits: int | None) -> Made:
    """Speed of the next pitch: the pitcher's own mean, or that of recent fastballs where it is known, drawn to the league's."""
    known, recent = F.col("f_avg_speed").isNotNull(), F.col("p_velo").isNotNull()
    n = F.when(recent, _n("f_pitches", "p_pitches")).otherwise(_n("f_pitches"))
    own = F.coalesce("p_velo", "f_avg_speed", F.lit(LEAGUE_SPEED))
    shift = F.lit(0.0)
    for (b, s), d in SPEED_SHIFTS.items():
        shift = F.when(_count(b, s), d).otherwise(shift)
    speed = P.blend(own, LEAGUE_SPEED, n, BLEND_N) + shift
    return ctx, {"predicted_mph": F.round(speed, digits or 2), **_row("pitch_speed_ou", n, _used(known, pitcher_rolling=recent), digits or 3)}


def pitch_result(ctx: DataFrame, digits: int | None) -> Made:
    """Chances of the next pitch's result: shares of the pitcher, then zone, chase and count."""
    names = list(LEAGUE_PITCH)
    known = F.col("f_strike_foul_rate").isNotNull()
    df = _started(ctx, known, {k: f"f_{k}_rate" for k in names}, LEAGUE_PITCH, _n("f_pitches"))
    hits: dict[str, Column] = {}
    for name, rate, t in (("pitcher_rolling", "p_zone_rate", ZONE), ("batter_rolling", "b_chase_rate", CHASE)):
        high, low = _true(F.col(rate) > t["high"]), _true(F.col(rate) < t["low"])
        hits[name] = high | low
        df = _moved(df, names, {"strike_foul": F.when(high, t["strike_foul"]).otherwise(0.0), "ball": F.when(low, t["ball"]).otherwise(0.0)}, hits[name])
    df = _at_counts(df, names, COUNT_SHIFTS)
    n = F.when(F.col("p_zone_rate").isNotNull(), _n("f_pitches", "p_pitches")).otherwise(_n("f_pitches"))
    return df, {**{f"p_{k}": F.round(_P + k, digits or 4) for k in names}, **_row("pitch_result", n, _used(known, **hits), digits or 3)}


def at_bat_result(ctx: DataFrame, digits: int | None) -> Made:
    """Chances of the plate appearance's result: shares of the pitcher, then hands, earlier meetings, the batter's form and the count."""
    names = list(LEAGUE_PA)
    known = F.col("f_k_rate").isNotNull()
    df = _started(ctx, known, {"strikeout": "f_k_rate", "walk": "f_bb_rate", "hit": "f_hit_rate", "out": "f_out_rate"}, LEAGUE_PA, _n("f_abs"))
    hands = P.platoon(F.col("pitch_hand"), F.col("bat_side"))
    for label, by in (("same", SAME_HAND), ("opposite", OPPOSITE_HAND)):
        df = _moved(df, names, by, _true(hands == label))
    met = _true(F.col("m_pa_count") >= MATCHUP_PA)
    part = {k: F.try_divide(F.coalesce(c, F.lit(0)).cast("double"), F.col("m_pa_count").cast("double")) for k, c in (("strikeout", "m_so_count"), ("walk", "m_bb_count"), ("hit", "m_h_count"))}
    part["out"] = F.greatest(F.lit(0.0), 1 - part["strikeout"] - part["walk"] - part["hit"])
    df = _normal(df.withColumns({_T + k: (1 - MATCHUP_SHARE) * F.col(_P + k) + MATCHUP_SHARE * part[k] for k in names}), names, met)
    hard, whiffer = _true(F.col("b_hard_hit_rate") > HARD_HIT), _true(F.col("b_k_rate") > WHIFFER)
    df = _moved(df, names, {"hit": F.when(hard, HARD_HIT_MORE).otherwise(0.0), "strikeout": F.when(whiffer, WHIFFER_MORE).otherwise(0.0)}, hard | whiffer)
    df = _at_counts(df, names, PA_SHIFTS)
    used = _used(known, platoon=hands.isNotNull(), matchup=met, batter_rolling=hard | whiffer)
    return df, {**{f"p_{k}": F.round(_P + k, digits or 4) for k in names}, **_row("ab_result", _n("f_abs"), used, digits or 3)}


def at_bat_pitches(ctx: DataFrame, digits: int | None) -> Made:
    """Pitches of the plate appearance; once it is as long as expected, a tail by the count."""
    known, n = F.col("f_avg_pitches").isNotNull(), _n("f_abs")
    few, patient = _true(F.col("p_zone_rate") < FEW_STRIKES), _true(F.col("b_chase_rate") < PATIENT)
    base = P.blend(F.coalesce("f_avg_pitches", F.lit(LEAGUE_PITCHES)), LEAGUE_PITCHES, n, BLEND_N) + F.when(few, FEW_STRIKES_MORE).otherwise(0.0) + F.when(patient, PATIENT_MORE).otherwise(0.0)
    now = F.coalesce("pitch_count_pa", F.lit(0))
    tail = F.when(_count(3, 2), FULL_COUNT_TAIL).when(F.coalesce("strikes", F.lit(0)) == 2, TWO_STRIKE_TAIL).otherwise(TAIL)
    used = _used(known, pitcher_rolling=few, batter_rolling=patient)
    return ctx, {"predicted_count": F.round(F.when(now >= base, now + tail).otherwise(base), digits or 2), "current_pitch_count": now, **_row("ab_pitches_ou", n, used, digits or 3)}


PREDICTORS = {"pitch_speed_ou": pitch_speed, "pitch_result": pitch_result, "ab_result": at_bat_result, "ab_pitches_ou": at_bat_pitches}
INPUTS = {
    **{c: "double" for c in ("f_avg_speed", "f_strike_foul_rate", "f_ball_rate", "f_in_play_rate", "f_k_rate", "f_bb_rate", "f_hit_rate", "f_out_rate", "f_avg_pitches", "p_velo", "p_zone_rate", "b_chase_rate", "b_k_rate", "b_hard_hit_rate")},
    **{c: "long" for c in ("f_pitches", "f_abs", "p_pitches", "m_pa_count", "m_so_count", "m_bb_count", "m_h_count")},
    **{c: "int" for c in ("balls", "strikes", "pitch_count_pa")},
    **{c: "string" for c in ("pitch_hand", "bat_side")},
}


def predict(ctx: DataFrame, market: str, keys: Sequence[str], digits: int | None = None) -> DataFrame:
    """The prediction of one market for every context row; inputs that ``ctx`` lacks count as unknown. Unknown markets raise."""
    if market not in PREDICTORS:
        raise ValueError(f"no predictor of {market}; known are {', '.join(PREDICTORS)}")
    whole = ctx.withColumns({c: F.lit(None).cast(t) for c, t in INPUTS.items() if c not in ctx.columns})
    df, made = PREDICTORS[market](whole, digits)
    return df.select(*keys, *(c.alias(k) for k, c in made.items()))


def context(positions: DataFrame, pitch_shares: DataFrame, at_bat_shares: DataFrame, pitcher_form: DataFrame, batter_form: DataFrame, matchups: DataFrame, hard_hit: DataFrame | None = None, day: str | None = "game_date") -> DataFrame:
    """Positions with everything known of their players, under the names of INPUTS."""
    on = [day] if day else []
    f = pitch_shares.select("pitcher_id", F.col("n").alias("f_pitches"), F.col("avg_speed").alias("f_avg_speed"), *(F.col(c).alias(f"f_{c}") for c in ("strike_foul_rate", "ball_rate", "in_play_rate")))
    a = at_bat_shares.select("pitcher_id", F.col("n").alias("f_abs"), F.col("avg_pitches").alias("f_avg_pitches"), F.col("so_rate").alias("f_k_rate"), *(F.col(c).alias(f"f_{c}") for c in ("bb_rate", "hit_rate", "out_rate")))
    p = pitcher_form.select("pitcher_id", *on, F.col("sample_pitches").alias("p_pitches"), F.col("zone_rate").alias("p_zone_rate"), F.col("avg_fastball_velo").alias("p_velo"))
    b = batter_form.select("batter_id", *on, *(F.col(c).alias(f"b_{c}") for c in ("chase_rate", "k_rate")))
    m = matchups.select("pitcher_id", "batter_id", *(F.col(c).alias(f"m_{c}") for c in ("pa_count", "so_count", "bb_count", "h_count")))
    out = positions.join(f, "pitcher_id", "left").join(a, "pitcher_id", "left").join(p, ["pitcher_id", *on], "left").join(b, ["batter_id", *on], "left").join(m, ["pitcher_id", "batter_id"], "left")
    return out if hard_hit is None else out.join(hard_hit.select("batter_id", F.col("hard_hit_rate").alias("b_hard_hit_rate")), "batter_id", "left")
