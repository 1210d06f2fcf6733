"""Quotes, prices and scores: latest quote, margin removal, edges, picks, and the market predictors."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions import predicates as P

# League shares, means and count adjustments of the predictors.
LEAGUE_PITCH = {"strike_foul": 0.455, "ball": 0.352, "in_play": 0.193}
LEAGUE_PA = {"strikeout": 0.221, "walk": 0.087, "hit": 0.239, "out": 0.453}
LEAGUE_SPEED, SPEED_SIGMA, LEAGUE_PITCHES, PITCHES_SIGMA = 92.8, 5.4, 3.85, 1.9
COUNT_SHIFTS = {
    (3, 0): {"ball": 0.08, "strike_foul": -0.05, "in_play": -0.03},
    (3, 1): {"ball": 0.04, "strike_foul": -0.02, "in_play": -0.02},
    (0, 2): {"strike_foul": 0.10, "ball": -0.07, "in_play": -0.03},
    (1, 2): {"strike_foul": 0.06, "ball": -0.04, "in_play": -0.02},
    (2, 2): {"strike_foul": 0.03, "ball": -0.02, "in_play": -0.01},
}
KEEP_OF_MODEL = 0.7
# Zone rates from which a pitcher moves the shares, and by how much; what counts do to plate appearances and speeds.
ZONE_HIGH, ZONE_LOW, MORE_STRIKES, MORE_BALLS = 0.52, 0.44, 0.03, 0.04
TWO_STRIKES = {"strikeout": 0.08, "hit": -0.04, "out": -0.04}
THREE_BALLS = {"walk": 0.12, "out": -0.06}
BELOW_FASTBALL, TWO_STRIKE_SPEED, THREE_BALL_SPEED = 2.2, 0.4, 0.3
STILL_TO_COME, STILL_AT_TWO_STRIKES = 1.6, 1.3
PITCHER_N, SPEED_N = 150.0, 300.0


def latest_quotes(odds: DataFrame, keys: Sequence[str], as_of: Column | None = None, minutes: int | None = None, ts: str = "fetched_at") -> DataFrame:
    """The newest quote of each key, no older than ``minutes`` before ``as_of``; ties go to the greater id."""
    fresh = odds
    if as_of is not None:
        fresh = fresh.where(F.col(ts) <= as_of)
        fresh = fresh.where(F.col(ts) >= as_of - F.make_dt_interval(mins=F.lit(minutes))) if minutes is not None else fresh
    rest = [c for c in odds.columns if c not in keys]
    return fresh.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, "id")).alias("q")).select(*keys, "q.*")


def without_margin(quotes: DataFrame, keys: Sequence[str] = ("game_pk", "market", "source"), digits: int = 4) -> DataFrame:
    """Implied probability, and what is left of it without the book's margin where both sides are quoted."""
    p = quotes.withColumn("implied_prob", P.american_to_probability(F.col("price_american")))
    w = Window.partitionBy(*keys)
    both = F.count("implied_prob").over(w) == 2
    fair = F.when(both, F.round(F.col("implied_prob") / F.sum("implied_prob").over(w), digits)).otherwise(F.col("implied_prob"))
    return p.withColumn("novig_prob", fair)


def moneyline_picks(quotes: DataFrame, games: DataFrame, win_share: DataFrame, least_edge: float = 0.05, digits: int = 4) -> DataFrame:
    """Sides whose chance by season strength beats the best price by ``least_edge``."""
    h = win_share.select(F.col("team_id").alias("home_team_id"), F.col("win_pct").alias("home_pct"))
    a = win_share.select(F.col("team_id").alias("away_team_id"), F.col("win_pct").alias("away_pct"))
    g = games.join(h, "home_team_id").join(a, "away_team_id").where("home_pct is not null and away_pct is not null").select("game_pk", P.log5(F.col("home_pct"), F.col("away_pct")).alias("p_home"))
    best = quotes.where("novig_prob is not null").groupBy("game_pk", "outcome").agg(F.min_by(F.struct("source", "price_american", "novig_prob"), F.struct("novig_prob", "source")).alias("b"))
    j = best.join(g, "game_pk").select("game_pk", F.col("outcome").alias("recommendation"), F.col("b.source").alias("book"), F.col("b.price_american").alias("price"), F.when(F.col("outcome") == "home", F.col("p_home")).otherwise(1 - F.col("p_home")).alias("p"), F.col("b.novig_prob").alias("market_prob"))
    return j.select("game_pk", "recommendation", "book", "price", F.round("p", digits).alias("confidence"), F.round(F.col("p") - F.col("market_prob"), digits).alias("edge")).where(F.col("edge") >= least_edge)


def edge_board(quotes: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The source with the greatest edge for each key: model chance less implied chance."""
    j = quotes.join(calls, list(keys)).withColumn("edge", F.round(F.col("model_prob") - F.col("novig_prob"), 4))
    best = F.max_by(F.struct("source", "price_american", "novig_prob", "edge"), F.struct("edge", F.col("source")))
    return j.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.*")


def normalized(probs: Mapping[str, Column]) -> dict[str, Column]:
    """Shares of 1, negative parts counted as none."""
    held = {k: F.greatest(F.lit(0.0), p) for k, p in probs.items()}
    total = sum(held.values(), F.lit(0.0))
    return {k: F.when(total > 0, h / total).otherwise(probs[k]) for k, h in held.items()}


def softmax(scores: Mapping[str, Column]) -> dict[str, Column]:
    most = F.greatest(*scores.values())
    e = {k: F.exp(z - most) for k, z in scores.items()}
    total = sum(e.values(), F.lit(0.0))
    return {k: x / total for k, x in e.items()}


def features(names: Sequence[str]) -> dict[str, Column]:
    """The named model inputs as columns of a scoring context. Unknown names raise."""
    v = F.col
    delta = lambda c, base: F.coalesce(v(c) - base, F.lit(0.0))
    known = {
        "bias": F.lit(1.0), "balls": v("balls"), "strikes": v("strikes"), "two_strikes": (v("strikes") >= 2).cast("int"), "three_balls": (v("balls") >= 3).cast("int"), "pitch_of_pa": v("pitch_count_pa") + 1,
        "pitcher_velo": P.blend(v("p_velo"), LEAGUE_SPEED, F.coalesce("p_pitches", F.lit(0)), SPEED_N), "pitcher_zone_delta": delta("p_zone_rate", 0.48), "pitcher_whiff_delta": delta("p_whiff_rate", 0.24),
        "pitcher_k_delta": delta("p_k_rate", LEAGUE_PA["strikeout"]), "pitcher_bb_delta": delta("p_bb_rate", LEAGUE_PA["walk"]), "batter_k_delta": delta("b_k_rate", LEAGUE_PA["strikeout"]), "batter_bb_delta": delta("b_bb_rate", LEAGUE_PA["walk"]),
        "batter_chase_delta": delta("b_chase_rate", 0.28), "batter_contact_delta": delta("b_contact_rate", 0.77), "platoon_same": F.coalesce(((v("pitch_hand") == v("bat_side")) & (v("bat_side") != "S")).cast("int"), F.lit(0)),
    }
    if unknown := set(names) - known.keys():
        raise ValueError(f"unknown features: {sorted(unknown)}")
    return {n: known[n] for n in names}


def linear(names: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    f = features(names)
    return sum((c * f[n] for n, c in zip(names, coef, strict=True)), F.lit(float(intercept)))


def pitch_result_probs(params: Mapping | None = None) -> dict[str, Column]:
    """Chances of the next pitch's result: a fitted model, or league shares moved by the count and the pitcher's zone rate."""
    if params:
        return softmax({c: linear(params["features"], w, b) for c, w, b in zip(params["classes"], params["coef"], params["intercept"], strict=True)})
    zone = F.col("p_zone_rate")
    probs = {}
    for k, base in LEAGUE_PITCH.items():
        shift = F.lit(0.0)
        for (b, s), d in COUNT_SHIFTS.items():
            shift = F.when((F.col("balls") == b) & (F.col("strikes") == s), F.lit(d[k])).otherwise(shift)
        probs[k] = F.greatest(F.lit(0.0), base + shift)
    probs["strike_foul"] += F.when(zone > ZONE_HIGH, MORE_STRIKES).otherwise(0.0)
    probs["ball"] += F.when(zone < ZONE_LOW, MORE_BALLS).otherwise(0.0)
    return normalized(probs)


def pa_result_probs(params: Mapping | None = None) -> dict[str, Column]:
    """Chances of the plate appearance's result; a fitted model is drawn towards the league's shares."""
    if params:
        p = softmax({c: linear(params["features"], w, b) for c, w, b in zip(params["classes"], params["coef"], params["intercept"], strict=True)})
        return normalized({c: KEEP_OF_MODEL * x + (1 - KEEP_OF_MODEL) * LEAGUE_PA.get(c, 0.0) for c, x in p.items()})
    n = F.coalesce("p_abs", F.lit(0))
    k = P.blend(F.col("p_k_rate"), LEAGUE_PA["strikeout"], n, PITCHER_N)
    bk = P.blend(F.col("b_k_rate"), LEAGUE_PA["strikeout"], F.coalesce("b_abs", F.lit(0)), PITCHER_N)
    k = F.when(F.col("b_k_rate").isNotNull(), (k + bk) / 2).otherwise(k)
    at = {"two": (F.col("strikes") >= 2).cast("int"), "three": (F.col("balls") >= 3).cast("int")}
    base = {"strikeout": k, "walk": P.blend(F.col("p_bb_rate"), LEAGUE_PA["walk"], n, PITCHER_N), "hit": F.lit(LEAGUE_PA["hit"]), "out": F.lit(LEAGUE_PA["out"])}
    return normalized({c: x + TWO_STRIKES.get(c, 0.0) * at["two"] + THREE_BALLS.get(c, 0.0) * at["three"] for c, x in base.items()})


def pitch_speed(params: Mapping | None = None) -> tuple[Column, float]:
    """Expected speed of the next pitch, and its deviation."""
    if params:
        return linear(params["features"], params["coef"], params["intercept"]), params.get("sigma", SPEED_SIGMA)
    mu = features(["pitcher_velo"])["pitcher_velo"] - BELOW_FASTBALL - F.when(F.col("strikes") == 2, TWO_STRIKE_SPEED).otherwise(0.0) + F.when(F.col("balls") == 3, THREE_BALL_SPEED).otherwise(0.0)
    return mu, SPEED_SIGMA


def pa_pitches(table: DataFrame | None = None) -> Column:
    """Expected pitches of the plate appearance; ``remaining_mean`` from a fitted table where the context has it."""
    now = F.col("pitch_count_pa")
    plain = F.when(now >= LEAGUE_PITCHES, now + F.when(F.col("strikes") == 2, STILL_AT_TWO_STRIKES).otherwise(STILL_TO_COME)).otherwise(LEAGUE_PITCHES)
    return plain if table is None else F.coalesce(now + F.col("remaining_mean"), F.greatest(now + 1, F.lit(LEAGUE_PITCHES)))


def over_line(mean: Column, sigma: float, line: Column) -> dict[str, Column]:
    """Side, its chance and its edge against even money."""
    over = 1 - P.normal_cdf((line - mean) / sigma)
    side = F.when(over >= 0.5, over).otherwise(1 - over)
    return {"recommendation": F.when(over >= 0.5, "over").otherwise("under"), "confidence": F.round(side, 4), "edge": F.round(side - 0.5, 4)}


def top_class(probs: Mapping[str, Column]) -> tuple[Column, Column]:
    """The likeliest class and its chance; ties go to the class named first."""
    most = F.greatest(*probs.values())
    name = F.lit(None).cast("string")
    for k in reversed(list(probs)):
        name = F.when(probs[k] == most, k).otherwise(name)
    return name, most


def scoring_context(pitches: DataFrame, pitcher_stats: DataFrame, batter_stats: DataFrame, day: str | None = None) -> DataFrame:
    """Open positions with the rolling figures of pitcher and batter; with ``day``, those of the position's own day."""
    on = [day] if day else []
    have = set(pitcher_stats.columns)
    speed = next((F.col(c) for c in ("avg_fastball_velo", "fastball_speed") if c in have), F.lit(None)).cast("double")
    rates = lambda side, names: [F.col(c).alias(f"{side}_{c}") for c in names]
    p = pitcher_stats.select("pitcher_id", *on, F.col("sample_pitches").alias("p_pitches"), F.col("sample_abs").alias("p_abs"), *rates("p", ("zone_rate", "whiff_rate", "k_rate", "bb_rate")), speed.alias("p_velo"))
    b = batter_stats.select("batter_id", *on, F.col("sample_abs").alias("b_abs"), *rates("b", ("chase_rate", "contact_rate", "k_rate", "bb_rate")))
    return pitches.withColumn("pitch_count_pa", F.col("pitch_number") - 1).join(p, ["pitcher_id", *on], "left").join(b, ["batter_id", *on], "left")


# League runs a team and game, and how starters, air, wind and parks move runs.
LEAGUE_RUNS, RATE_N, STARTER_N = 4.4, 40.0, 200.0
STARTER_STRIKEOUTS, STARTER_WALKS, STARTER_SHARE, STARTER_RANGE = 1.6, 1.1, 0.6, (0.78, 1.22)
MILD, A_DEGREE, AIR_RANGE = 70, 0.004, (0.94, 1.08)
WIND_OUT, OUT_RANGE, WIND_IN, IN_RANGE = 0.006, (1.0, 1.10), 0.005, (0.92, 1.0)
PARK_RANGE, RUNS_RANGE, LEAST_SIGMA = (0.85, 1.18), (4.5, 14.0), 3.0


def _held(x: Column, within: tuple[float, float]) -> Column:
    """Within the range; unknown stays unknown, as ``least`` and ``greatest`` would pass over it."""
    return F.when(x.isNotNull(), F.least(F.lit(within[1]), F.greatest(F.lit(within[0]), x)))


def starter_factor(k_rate: Column, bb_rate: Column, pa: Column) -> Column:
    """What a starter does to the runs of the other side; 1 where nothing is known of them."""
    n = F.coalesce(pa, F.lit(0))
    k, bb = P.blend(k_rate, LEAGUE_PA["strikeout"], n, STARTER_N), P.blend(bb_rate, LEAGUE_PA["walk"], n, STARTER_N)
    effect = STARTER_WALKS * (bb - LEAGUE_PA["walk"]) - STARTER_STRIKEOUTS * (k - LEAGUE_PA["strikeout"])
    return F.when(pa.isNull(), 1.0).otherwise(_held(1 + STARTER_SHARE * effect, STARTER_RANGE))


def weather_factor(temp_f: Column, wind_mph: Column, wind_direction: Column) -> Column:
    """Warm air and wind out add runs, wind in takes some; unknown weather does nothing."""
    warm = F.coalesce(_held(1 + A_DEGREE * (temp_f - MILD), AIR_RANGE), F.lit(1.0))
    to, mph = F.lower(F.coalesce(wind_direction, F.lit(""))), F.coalesce(wind_mph, F.lit(0)).cast("double")
    wind = F.when((mph > 0) & to.contains("out"), _held(1 + WIND_OUT * mph, OUT_RANGE)).when((mph > 0) & to.contains("in"), _held(1 - WIND_IN * mph, IN_RANGE)).otherwise(1.0)
    return warm * wind


def game_totals(games: DataFrame, rates: DataFrame, parks: DataFrame, starters: DataFrame | None = None, profiles: DataFrame | None = None, on: Sequence[str] = ()) -> DataFrame:
    """Expected runs of each game from both teams' rates, starters, park and weather, and their deviation.

    ``starters`` (game_pk, home_pitcher_id, away_pitcher_id) with ``profiles`` (pitcher_id,
    k_rate, bb_rate, pa): the away starter moves the home side's runs and the other
    way round; a side without a known starter stays as it is. ``on`` names further
    columns by which figures belong to a game (its day, for figures as they stood).
    """
    on = list(on)
    side = lambda s: rates.select(F.col("team_id").alias(f"{s}_team_id"), *on, F.col("rs_pg").alias(f"{s}_rs"), F.col("ra_pg").alias(f"{s}_ra"), F.col("games").alias(f"{s}_n"))
    g = games.join(side("home"), ["home_team_id", *on], "left").join(side("away"), ["away_team_id", *on], "left").join(parks.select("venue_id", *on, "factor"), ["venue_id", *on], "left")
    factor = {"home": F.lit(1.0), "away": F.lit(1.0)}
    if starters is not None and profiles is not None:
        g = g.join(starters.select("game_pk", *(f"{s}_pitcher_id" for s in factor)), "game_pk", "left")
        for s in factor:
            own = profiles.select(F.col("pitcher_id").alias(f"{s}_pitcher_id"), *on, *(F.col(c).alias(f"{s}_s_{c}") for c in ("k_rate", "bb_rate", "pa")))
            g = g.join(own, [f"{s}_pitcher_id", *on], "left")
            factor[s] = starter_factor(*(F.col(f"{s}_s_{c}") for c in ("k_rate", "bb_rate", "pa")))
    have = {c: F.col(c) if c in games.columns else F.lit(None) for c in ("temp_f", "wind_mph", "wind_direction")}
    n = F.least(F.coalesce("home_n", F.lit(0)), F.coalesce("away_n", F.lit(0)))
    part = lambda c: P.blend(F.col(c), LEAGUE_RUNS, n, RATE_N)
    runs = (part("home_rs") + part("away_ra")) / 2 * factor["away"] + (part("away_rs") + part("home_ra")) / 2 * factor["home"]
    park = F.coalesce(_held(F.col("factor"), PARK_RANGE), F.lit(1.0))
    mu = _held(runs * park * weather_factor(have["temp_f"].cast("double"), have["wind_mph"].cast("double"), have["wind_direction"].cast("string")), RUNS_RANGE)
    return g.select("game_pk", n.cast("long").alias("sample_games"), mu.alias("mu")).withColumn("sigma", F.greatest(F.lit(LEAST_SIGMA), F.sqrt(2 * F.col("mu"))))


def pending_positions(pitches: DataFrame, done: DataFrame, open_pa: DataFrame, lookback: int = 4) -> DataFrame:
    """Positions of the latest plate appearances that still lack a call.

    Position k is a call after k pitches. A finished plate appearance has one
    for each pitch thrown; an open one also has its forward position. Open
    plate appearances (game_pk, at_bat_index) may have no pitch yet.
    """
    thrown = pitches.groupBy("game_pk", "at_bat_index").agg(F.count("pitch_number").alias("n"))
    both = thrown.join(open_pa.select("game_pk", "at_bat_index", F.lit(True).alias("open")), ["game_pk", "at_bat_index"], "full")
    newest = both.groupBy("game_pk").agg(F.max("at_bat_index").alias("newest"))
    live = both.join(newest, "game_pk").where(F.col("at_bat_index") > F.col("newest") - lookback)
    last = F.coalesce("n", F.lit(0)) - F.when(F.col("open"), 0).otherwise(1)
    todo = live.withColumn("last", last).where("last >= 0").select("game_pk", "at_bat_index", F.coalesce("open", F.lit(False)).alias("open"), F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias("pitch_number"))
    return todo.join(done.select("game_pk", "at_bat_index", F.col("pitch_number").cast("int").alias("pitch_number")).distinct(), ["game_pk", "at_bat_index", "pitch_number"], "left_anti")
