"""Pitch predicates and small arithmetic that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pitch types counted as fastballs, and plate appearances that are no at-bats.
FASTBALLS = ("FF", "FT", "SI", "FC")
NO_AT_BAT = ("walk", "intent_walk", "hit_by_pitch", "sac_fly", "sac_bunt", "catcher_interf")
EXTRA_BASE = ("double", "triple", "home_run")


def swung() -> Column:
    return F.col("description").isin("swinging_strike", "foul") | (F.col("result_category") == "in_play")


def whiff() -> Column:
    return F.col("description") == "swinging_strike"


def contact() -> Column:
    return (F.col("description") == "foul") | (F.col("result_category") == "in_play")


def fastball() -> Column:
    return F.col("pitch_type").isin(*FASTBALLS)


def in_zone() -> Column:
    return F.col("zone").between(1, 9)


def out_of_zone() -> Column:
    return F.col("zone") > 9


def barrel() -> Column:
    """Exit speed of 98 and more, in a band of launch angles that widens with it."""
    over = F.col("launch_speed") - 98
    return (F.col("launch_speed") >= 98) & F.col("launch_angle").between(26 - over, 30 + over)


def share(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole, rounded; null where there is nothing to divide by."""
    return F.round(F.try_divide(part.cast("double"), F.nullif(whole, F.lit(0)).cast("double")), digits)


def rounded(x: Column, digits: int) -> Column:
    """The whole number nearest to x times a power of ten, divided by it again, as the published figures are rounded.

    ``round`` goes by a double's written digits. The two part at ties that a double
    misses by its last bit: 88.30499999999999 times 100 is 8830.5, so this gives 88.31.
    """
    scale = float(10**digits)
    return F.round(x * scale) / scale


def rate(condition: Column, digits: int | None = 4) -> Column:
    """Share of rows for which a condition holds; unknown counts as not."""
    r = F.avg(F.when(condition, 1.0).otherwise(0.0))
    return F.round(r, digits) if digits is not None else r


def american_to_probability(price: Column) -> Column:
    """Implied probability of American odds; null for null."""
    p = price.cast("double")
    return F.when(p < 0, -p / (100 - p)).when(p >= 0, 100 / (100 + p))


def probability_to_american(p: Column) -> Column:
    """American odds of a probability strictly between 0 and 1, else null."""
    ok = (p > 0) & (p < 1)
    return F.when(ok & (p >= 0.5), F.round(-100 * p / (1 - p))).when(ok, F.round(100 * (1 - p) / p)).cast("int")


def win_profit(price: Column, units: Column) -> Column:
    """Profit of a won bet; at even money where there is no price."""
    p = price.cast("double")
    return F.round(F.when(p > 0, units * p / 100).when(p < 0, units * 100 / -p).otherwise(units), 3)


# The five-term polynomial for the normal tail (Abramowitz and Stegun 26.2.17).
TAIL_SLOPE, TAIL_DENSITY = 0.2316419, 0.3989423
TAIL_TERMS = (0.3193815, -0.3565638, 1.781478, -1.821256, 1.330274)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution, by the tail polynomial."""
    t = 1 / (1 + TAIL_SLOPE * F.abs(x))
    poly = F.lit(0.0)
    for c in reversed(TAIL_TERMS):
        poly = t * (c + poly)
    tail = TAIL_DENSITY * F.exp(-x * x / 2) * poly
    return F.when(x > 0, 1 - tail).otherwise(tail)


def blend(value: Column, league: Column | float, n: Column, k: float) -> Column:
    """Shrink a value towards the league's: weight 0.85 (1 - exp(-n / k)) on the value."""
    w = 0.85 * (1 - F.exp(-n.cast("double") / k))
    base = league if isinstance(league, Column) else F.lit(float(league))
    return F.when(value.isNull(), base).otherwise(w * value + (1 - w) * base)


def confidence(n: Column, k: float) -> Column:
    """Confidence after n observations, from 0.50 up to 0.82."""
    return 0.5 + 0.32 * (1 - F.exp(-n.cast("double") / k))


def log5(home: Column, away: Column, advantage: float = 0.542) -> Column:
    """Chance of the home side from two win shares, with home advantage in odds space; between .05 and .95, null if a share is."""
    h, a = F.greatest(F.lit(0.05), F.least(F.lit(0.95), home)), F.greatest(F.lit(0.05), F.least(F.lit(0.95), away))
    neutral = h * (1 - a) / (h * (1 - a) + a * (1 - h))
    odds = neutral / (1 - neutral) * (advantage / (1 - advantage))
    return F.when(home.isNotNull() & away.isNotNull(), F.greatest(F.lit(0.05), F.least(F.lit(0.95), odds / (1 + odds))))


def eastern_day(ts: Column) -> Column:
    """Calendar day of an instant (UTC) on the US East coast."""
    return F.to_date(F.from_utc_timestamp(ts, "America/New_York"))


def step_bucket(value: Column, base: float, step: float) -> Column:
    """floor((value - base) / step); unknown values fall into bucket 0.

    The quotient is rounded to nine places first, so that the order of a sum
    does not move a value across an edge.
    """
    return F.floor(F.round(F.coalesce(value - base, F.lit(0.0)) / step, 9)).cast("int")


def near_bucket(value: Column, base: float, step: float, most: int = 2) -> Column:
    """Nearest step from the base, held within +-most; unknown is 0."""
    return F.least(F.lit(most), F.greatest(F.lit(-most), F.coalesce(F.round((value - base) / step), F.lit(0)))).cast("int")


def platoon(pitch_hand: Column, bat_side: Column) -> Column:
    """"same" or "opposite" by the hands of pitcher and batter; who bats from both sides is always opposite, an unknown hand gives null."""
    p, b = (F.upper(F.substring(c, 1, 1)) for c in (pitch_hand, bat_side))
    known = p.isin("L", "R") & b.isin("L", "R")
    return F.when((F.length(pitch_hand) > 0) & (b == "S"), "opposite").when(known, F.when(p == b, "same").otherwise("opposite"))


# States of a game that is over.
FINAL = ("Final", "Game Over", "Completed Early")


def is_final(status: Column) -> Column:
    """Whether a game is over."""
    return status.startswith(FINAL[0]) | status.isin(*FINAL)
