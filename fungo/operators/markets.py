"""The markets that are fitted, and what each is fitted from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from fungo.operators import features as X
from fungo.operators.models import MarketSpec

WINDOWS = ("career", "d30", "d90")

SPECS: dict[str, MarketSpec] = {
    s.market: s
    for s in (
        MarketSpec("pitch_result", "multinomial", lambda p, a, g: X.pitch_result_cells(p), ("balls", "strikes", "two_strikes", "three_balls", "pitcher_zone_delta"), ("strike_foul", "ball", "in_play"), WINDOWS, "zone_bucket", X.ZONE_BASE, X.ZONE_STEP),
        MarketSpec("ab_result", "multinomial", lambda p, a, g: X.at_bat_result_cells(a), ("pitcher_k_delta",), ("strikeout", "walk", "hit", "out"), WINDOWS, "zone_bucket", X.STRIKEOUT_BASE, X.STRIKEOUT_STEP),
        MarketSpec("pitch_speed_ou", "linear", lambda p, a, g: X.pitch_speed_cells(p), ("pitcher_velo", "balls", "strikes", "pitch_of_pa"), (), WINDOWS, "velo_bucket", X.SPEED_BASE, X.SPEED_STEP, "rmse"),
        MarketSpec("ab_pitches_ou", "remaining", lambda p, a, g: X.remaining_pitch_cells(p, a), windows=("career",)),
        MarketSpec("game_moneyline", "log5", lambda p, a, g: X.moneyline_cells(g), windows=("career",), metric="brier"),
    )
}


def spec_of(market: str) -> MarketSpec:
    """The spec of a market; an unknown one raises."""
    if market not in SPECS:
        raise ValueError(f"unknown market {market}; known are {', '.join(SPECS)}")
    return SPECS[market]


def cells_of(market: str, pitches: DataFrame, at_bats: DataFrame, games: DataFrame) -> DataFrame:
    return spec_of(market).cells(pitches, at_bats, games)
