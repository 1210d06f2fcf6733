"""Scoring of whole slates and of finished games, each with the figures of the day before, and rows that stay as first published."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators import asof
from fungo.operators import pricing as R
from fungo.sources import datasets as D

VERSION = "heuristic_v0"
MARKETS = ("pitch_result", "ab_result", "pitch_speed_ou", "ab_pitches_ou", "game_moneyline", "game_total")
KEY = ("game_pk", "market", "phase")
#: Positions of one plate appearance that are scored, counted back from its last.
MOST_POSITIONS = 20


def mean_of(a: Mapping[str, Column], b: Mapping[str, Column]) -> dict[str, Column]:
    """Mean of two maps of chances, class by class."""
    return {k: (a[k] + b[k]) / 2 for k in a}


_CALL = ("predicted_value", "confidence", "recommendation", "line", "price", "edge", "book", "model_version")
_TYPES = {"predicted_value": "double", "confidence": "double", "recommendation": "string", "line": "double", "price": "int", "edge": "double", "book": "string", "model_version": "string"}


def _call(market: str, **parts: Column) -> Column:
    return F.struct(F.lit(market).alias("market"), *(parts.get(c, F.lit(None)).cast(_TYPES[c]).alias(c) for c in _CALL))


def with_line_call(df: DataFrame, market: str, mean: Column, sigma: Column | float, version: str, quote: Column | None = None) -> DataFrame:
    """``df`` with a column ``__<market>``: side, line, price, edge and book of an over/under.

    Against the quote (line, over_price, under_price, source) where there is one,
    else at even money on the model's own line. Each step is a projection of its
    own, so that the chance is worked out once.
    """
    m, at, over, q = (F.col(f"__{market}_{c}") for c in ("mean", "at", "over", "quote"))
    none = F.lit(None).cast("struct<line:double,over_price:int,under_price:int,source:string>")
    df = df.withColumns({f"__{market}_mean": mean.cast("double"), f"__{market}_sigma": sigma if isinstance(sigma, Column) else F.lit(float(sigma)), f"__{market}_quote": quote if quote is not None else none})
    own = F.floor(m * 2 + 0.5) / 2  # nearest half, halves up
    df = df.withColumn(f"__{market}_at", F.coalesce(q["line"].cast("double"), own))
    df = df.withColumn(f"__{market}_over", 1 - P.normal_cdf((at - m) / F.col(f"__{market}_sigma")))
    quoted, side = q["line"].isNotNull(), F.greatest(over, 1 - over)
    price = F.when(quoted, F.when(over >= 0.5, q["over_price"]).otherwise(q["under_price"])).otherwise(F.lit(100))
    implied = F.when(quoted, P.american_to_probability(price)).otherwise(F.lit(0.5))
    made = _call(
        market,
        predicted_value=m,
        confidence=F.round(side, 4),
        recommendation=F.when(over >= 0.5, "over").when(over < 0.5, "under"),
        line=at,
        price=price,
        edge=F.round(side - implied, 4),
        book=F.when(quoted, q["source"]).otherwise(F.lit("model_fair")),
        model_version=F.lit(version),
    )
    return df.withColumn(f"__{market}", made)


def with_class_call(df: DataFrame, market: str, probs: Mapping[str, Column], digits: int, version: str) -> DataFrame:
    """``df`` with a column ``__<market>``: the likeliest class and its chance."""
    df = df.withColumns({f"__{market}_{k}": F.round(p, digits) for k, p in probs.items()})
    name, most = R.top_class({k: F.col(f"__{market}_{k}") for k in probs})
    return df.withColumn(f"__{market}", _call(market, predicted_value=most, confidence=most, recommendation=name, model_version=F.lit(version)))


def _line_quotes(quotes: DataFrame) -> DataFrame:
    """One line quote a game and market: the newest, ties to the lesser source."""
    best = F.max_by(F.struct("line", "over_price", "under_price", "source"), F.struct("fetched_at", "id"))
    q = quotes.where("line is not null").groupBy("game_pk", "market").agg(best.alias("q"))
    return q.groupBy("game_pk").agg(F.map_from_entries(F.collect_list(F.struct("market", "q"))).alias("lines"))  # at most a line a market


def _money_quotes(quotes: DataFrame) -> DataFrame:
    best = F.max_by(F.struct("price_american", "source"), F.struct("fetched_at", "id"))
    q = quotes.where("market = 'game_moneyline' and outcome in ('home', 'away')").groupBy("game_pk", "outcome").agg(best.alias("q"))
    return q.groupBy("game_pk").agg(F.map_from_entries(F.collect_list(F.struct("outcome", "q"))).alias("sides"))  # two sides


def slate_scores(games: DataFrame, history: DataFrame, starters: DataFrame, pitches: DataFrame, at_bats: DataFrame, lines: DataFrame, prices: DataFrame, phase: str = "pregame", digits: int = 6) -> DataFrame:
    """Six markets of each scheduled game before it begins: classes, speed, pitches, side and total.

    Every figure is that of the days before the game's own: rolling figures and
    profiles of both probable ``starters``, team rates of the season so far, park
    factors of this and three seasons before. ``history`` holds finished games.
    ``lines`` (game_pk, market, line, over_price, under_price, source, fetched_at, id)
    and ``prices`` (game_pk, market, outcome, price_american, source, fetched_at, id) are quotes at hand.
    An unknown starter counts as the league's; a batter is not known before a game.
    """
    g = games.select("game_pk", "game_date", "season", "home_team_id", "away_team_id", "venue_id").join(starters, "game_pk", "left")
    sides = ("home", "away")
    asked = g.select(F.explode(F.array(*(F.col(f"{s}_pitcher_id") for s in sides))).alias("pitcher_id"), "game_date").where("pitcher_id is not null").distinct()
    rolling = asof.rolling_before(pitches, at_bats, "pitcher_id", asked, speed_digits=digits)
    teams = g.select(F.explode(F.array(*(F.col(f"{s}_team_id") for s in sides))).alias("team_id"), "game_date").distinct()
    rates = asof.team_rates_before(history, teams)
    parks = asof.park_factors_before(history, g.select("venue_id", "game_date"))
    totals = R.game_totals(g.select("game_pk", "game_date", "home_team_id", "away_team_id", "venue_id"), rates, parks, starters, asof.profile_before(pitches, at_bats, asked), on=["game_date"])
    for s in sides:
        own = rolling.select(F.col("pitcher_id").alias(f"{s}_pitcher_id"), "game_date", F.struct(*(F.col(c) for c in rolling.columns if c not in ("pitcher_id", "game_date"))).alias(f"{s}_form"))
        rate = rates.select(F.col("team_id").alias(f"{s}_team_id"), "game_date", F.col("win_pct").alias(f"{s}_win"))
        g = g.join(own, [f"{s}_pitcher_id", "game_date"], "left").join(rate, [f"{s}_team_id", "game_date"], "left")
    g = g.join(totals, "game_pk", "left").join(_line_quotes(lines), "game_pk", "left").join(_money_quotes(prices), "game_pk", "left")
    # each side's figures under the names that the predictors read
    known = ("zone_rate", "whiff_rate", "k_rate", "bb_rate")
    form = {s: {"p_pitches": f"{s}_form.sample_pitches", "p_abs": f"{s}_form.sample_abs", "p_velo": f"{s}_form.avg_fastball_velo", **{f"p_{c}": f"{s}_form.{c}" for c in known}} for s in sides}
    blank = {"b_abs": "long", **{f"b_{c}": "double" for c in ("chase_rate", "contact_rate", "k_rate", "bb_rate")}, "balls": "int", "strikes": "int", "pitch_count_pa": "int"}
    start = {c: F.lit(0 if c in ("balls", "strikes", "pitch_count_pa") else None).cast(t) for c, t in blank.items()}
    both = g.withColumns(start)
    for s in sides:
        both = both.withColumns({k: F.col(v) for k, v in form[s].items()})
        pitch, result = R.pitch_result_probs(), R.pa_result_probs()
        mu, sigma = R.pitch_speed()
        both = both.withColumns({**{f"{s}_pr_{k}": c for k, c in pitch.items()}, **{f"{s}_ab_{k}": c for k, c in result.items()}, f"{s}_mu": F.round(mu, 2), f"{s}_pitches": F.round(R.pa_pitches(), 2)})
    mean = lambda kind, names: mean_of(*({k: F.col(f"{s}_{kind}_{k}") for k in names} for s in sides))
    quote = lambda m: F.try_element_at("lines", F.lit(m))
    half = lambda c: F.coalesce(c, F.lit(0.5))
    both = both.withColumn("p_home", P.log5(half(F.col("home_win")), half(F.col("away_win"))))
    home = F.col("p_home")
    both = both.withColumns({"side": F.when(home >= 0.5, "home").otherwise("away"), "p_side": F.greatest(home, 1 - home)}).withColumn("money", F.try_element_at("sides", F.col("side")))
    side, p_side, money = F.col("side"), F.col("p_side"), F.col("money")
    money_call = _call(
        "game_moneyline",
        predicted_value=F.round(home, 4),
        confidence=F.round(p_side, 4),
        recommendation=side,
        price=F.coalesce(money["price_american"], P.probability_to_american(p_side)),
        edge=F.round(p_side - P.american_to_probability(money["price_american"]), 4),
        book=F.coalesce(money["source"], F.lit("model_fair")),
        model_version=F.lit("log5_v1"),
    )
    out = with_class_call(both.withColumn("__game_moneyline", money_call), "pitch_result", mean("pr", R.LEAGUE_PITCH), digits, VERSION)
    out = with_class_call(out, "ab_result", mean("ab", R.LEAGUE_PA), digits, VERSION)
    out = with_line_call(out, "pitch_speed_ou", (F.col("home_mu") + F.col("away_mu")) / 2, R.SPEED_SIGMA, VERSION, quote("pitch_speed_ou"))
    out = with_line_call(out, "ab_pitches_ou", (F.col("home_pitches") + F.col("away_pitches")) / 2, R.PITCHES_SIGMA, VERSION, quote("ab_pitches_ou"))
    out = with_line_call(out, "game_total", F.round("mu", 2), F.col("sigma"), "total_v1", quote("game_total"))
    calls = F.array(*(F.col(f"__{m}") for m in MARKETS))
    return out.select("game_pk", F.col("game_date").alias("official_date"), F.lit(phase).alias("phase"), F.explode(calls).alias("c")).select("game_pk", "official_date", "phase", "c.*")


def publish_frozen(existing: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows once published stay; only keys (game, market, phase) that are new are added."""
    return D.new_rows(existing, scores.select(*existing.columns), KEY)


def closed_positions(pitches: DataFrame, done: DataFrame, most: int = MOST_POSITIONS) -> DataFrame:
    """Positions of finished plate appearances without a call, with the count there: k after k pitches, none after the last one.

    Of a plate appearance with more than ``most`` before its last position only the latest are taken.
    """
    thrown = pitches.where("pitch_number is not null")
    ends = thrown.groupBy("game_pk", "at_bat_index").agg(F.max("pitch_number").alias("n"), F.min("pitcher_id").alias("pitcher_id"), F.min("batter_id").alias("batter_id"), F.min("game_date").alias("game_date"))
    counts = thrown.select("game_pk", "at_bat_index", F.col("pitch_number").alias("k"), "balls", "strikes")
    first = ends.select("game_pk", "at_bat_index", F.lit(0).alias("k"), F.lit(0).alias("balls"), F.lit(0).alias("strikes"))
    at = counts.unionByName(first).dropDuplicates(["game_pk", "at_bat_index", "k"]).join(ends, ["game_pk", "at_bat_index"])
    todo = at.where((F.col("k") < F.col("n")) & (F.col("k") >= F.col("n") - 1 - most)).withColumn("k", F.col("k").cast("int"))
    had = done.select("game_pk", "at_bat_index", F.col("pitch_number").cast("int").alias("k")).distinct()
    return todo.join(had, ["game_pk", "at_bat_index", "k"], "left_anti").select("game_pk", "at_bat_index", F.col("k").alias("pitch_number"), "pitcher_id", "batter_id", "game_date", "balls", "strikes")


def backfill(pitches: DataFrame, at_bats: DataFrame, games: DataFrame, done: DataFrame, at: Column, markets_done: str = "pitch_result", digits: int = 6) -> DataFrame:
    """Calls on every position of finished games that has none: pitch result, plate-appearance result and speed, with the figures before the game's day.

    The pitches of the whole plate appearance are called once, at the earliest
    position written, where ``done`` has no such call. ``backfilled_at`` marks the
    rows; no picks are made of them, as nobody could have taken one.
    """
    final = games.where(P.is_final(F.col("status"))).select("game_pk").distinct()
    own = pitches.join(final, "game_pk", "left_semi")
    todo = closed_positions(own, done.where(F.col("market") == markets_done))
    ask = lambda who: own.select(who, "game_date").distinct()
    form = [asof.rolling_before(pitches, at_bats, who, ask(who), speed_digits=digits) for who in ("pitcher_id", "batter_id")]
    ctx = R.scoring_context(todo.withColumn("pitch_number", F.col("pitch_number") + 1), *form, day="game_date")
    had = done.where("market = 'ab_pitches_ou'").select("game_pk", "at_bat_index").distinct().withColumn("__had", F.lit(True))
    first = todo.groupBy("game_pk", "at_bat_index").agg(F.min("pitch_number").alias("__first"))
    ctx = ctx.join(first, ["game_pk", "at_bat_index"]).join(had, ["game_pk", "at_bat_index"], "left")
    mu, sigma = R.pitch_speed()
    out = with_line_call(ctx, "pitch_speed_ou", F.round(mu, 2), sigma, VERSION)
    out = with_line_call(out, "ab_pitches_ou", F.round(R.pa_pitches(), 2), R.PITCHES_SIGMA, VERSION)
    out = with_class_call(out, "pitch_result", R.pitch_result_probs(), digits, VERSION)
    out = with_class_call(out, "ab_result", R.pa_result_probs(), digits, VERSION)
    once = F.col("__had").isNull() & (F.col("pitch_count_pa") == F.col("__first"))
    calls = F.array_compact(F.array(F.col("__pitch_speed_ou"), F.col("__pitch_result"), F.col("__ab_result"), F.when(once, F.col("__ab_pitches_ou"))))
    rows = out.select("game_pk", "at_bat_index", F.col("pitch_count_pa").alias("pitch_number"), F.explode(calls).alias("c"))
    return rows.select("game_pk", "at_bat_index", "pitch_number", "c.*", at.cast("timestamp").alias("backfilled_at"))


def starters_of_plays(at_bats: DataFrame) -> DataFrame:
    """Who began for each side: the pitcher of the first plate appearance of each half."""
    half = F.when(F.col("top_inning"), "home").otherwise("away")
    first = at_bats.groupBy("game_pk", half.alias("side")).agg(F.min_by("pitcher_id", "at_bat_index").alias("pitcher_id"))
    return first.groupBy("game_pk").agg(*(F.max(F.when(F.col("side") == s, F.col("pitcher_id"))).alias(f"{s}_pitcher_id") for s in ("home", "away")))

