"""Settlement of calls against what happened, and the rollups of graded calls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions import predicates as P

def next_event(calls: DataFrame, events: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], prefix: str = "next_") -> DataFrame:
    """``calls`` with ``values`` of the first event of the same key that is strictly later in ``order``.

    Both sides are put in one sequence and the next event is looked up by a
    window, so no call meets more than one event. An event with the call's own
    place is not later. Null parts of a call's place count as before the start.
    """
    place = [F.coalesce(F.col(c), F.lit(-1)).alias(f"__{c}") for c in order]
    left = calls.select(*(F.col(k).alias(f"__k_{k}") for k in keys), *place, F.lit(1).alias("__call"), F.struct(*calls.columns).alias("__row"), F.lit(None).cast(events.select(F.struct(*values)).schema[0].dataType).alias("__event"))
    right = events.where(" and ".join(f"{c} is not null" for c in order)).select(*(F.col(k).alias(f"__k_{k}") for k in keys), *(F.col(c).alias(f"__{c}") for c in order), F.lit(0).alias("__call"), F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.struct(*values).alias("__event"))
    w = Window.partitionBy(*(f"__k_{k}" for k in keys)).orderBy(*(f"__{c}" for c in order), "__call").rowsBetween(1, Window.unboundedFollowing)
    both = left.unionByName(right).withColumn("__next", F.first("__event", ignorenulls=True).over(w)).where("__call = 1")
    # keys come from the window's own columns, so that a join on them needs no second shuffle
    own = (F.col(f"__k_{c}" if c in keys else f"__row.{c}").alias(c) for c in calls.columns)
    return both.select(*own, F.col("__next").isNotNull().alias(f"{prefix}found"), *(F.col(f"__next.{v}").alias(f"{prefix}{v}") for v in values))


def graded(won: Column, price: Column, units: Column) -> tuple[Column, Column]:
    """Result and profit of a decided call."""
    return F.when(won, "win").otherwise("loss"), F.when(won, P.win_profit(price, units)).otherwise(-units)


def settle_pitch_calls(calls: DataFrame, pitches: DataFrame, games: DataFrame) -> DataFrame:
    """Calls on the next pitch with result, profit_units, actual_value and actual_label.

    Without a next pitch a call stays open while its game goes on and is void
    after it; so is a call whose pitch lacks what it was about.
    """
    seen = next_event(calls, pitches, ["game_pk"], ["at_bat_index", "pitch_number"], ["start_speed", "result_category"])
    status = games.select("game_pk", "status").dropDuplicates(["game_pk"])
    r = seen.join(status, "game_pk", "left")
    speed = F.col("market") == "pitch_speed_ou"
    label = F.when(speed, F.when(F.col("next_start_speed") > F.col("line"), "over").when(F.col("next_start_speed").isNotNull() & F.col("line").isNotNull(), "under")).otherwise(F.col("next_result_category"))
    won = F.col("recommendation") == label
    result = (
        F.when(F.col("recommendation").isNull(), "void")
        .when(~F.col("next_found"), F.when(P.is_final(F.coalesce("status", F.lit("Final"))), "void"))
        .when(label.isNull(), "void")
        .when(won, "win")
        .otherwise("loss")
    )
    r = r.withColumn("result", result)
    decided = F.col("result").isin("win", "loss")
    profit = F.when(F.col("result") == "win", P.win_profit(F.col("price"), F.lit(1.0))).when(F.col("result") == "loss", -1.0).when(F.col("result") == "void", 0.0)
    return r.select(*calls.columns, "status", "result", profit.alias("profit_units"), F.when(decided & speed, F.col("next_start_speed")).alias("actual_value"), F.when(decided, label).alias("actual_label"))


def fill_actuals(calls: DataFrame, pitches: DataFrame, games: DataFrame) -> DataFrame:
    """Actuals of graded calls that lack them, for finished games; results stay as they are."""
    done = games.where(P.is_final(F.col("status"))).select("game_pk")
    todo = calls.where("result in ('win', 'loss', 'push') and actual_value is null and actual_label is null").join(done, "game_pk", "left_semi")
    seen = next_event(todo, pitches, ["game_pk"], ["at_bat_index", "pitch_number"], ["start_speed", "result_category"])
    speed = F.col("market") == "pitch_speed_ou"
    known = F.when(speed, F.col("next_start_speed").isNotNull() & F.col("line").isNotNull()).otherwise(F.col("next_result_category").isNotNull())
    label = F.when(speed, F.when(F.col("next_start_speed") > F.col("line"), "over").otherwise("under")).otherwise(F.col("next_result_category"))
    return seen.where(known).select("id", F.when(speed, F.col("next_start_speed")).alias("actual_value"), label.alias("actual_label"))


def game_actuals(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Mean speed, mean pitches a plate appearance and the commonest pitch result of each game; ties go to the first name."""
    p = pitches.groupBy("game_pk").agg(F.round(F.avg("start_speed"), 2).alias("mean_speed"), F.count("result_category").alias("n_categories"))
    c = pitches.where("result_category is not null").groupBy("game_pk", "result_category").count()
    top = c.groupBy("game_pk").agg(F.min_by("result_category", F.struct(-F.col("count"), F.col("result_category"))).alias("modal_category"), F.max("count").alias("modal_n"))
    a = at_bats.groupBy("game_pk").agg(F.round(F.avg("pitch_count"), 2).alias("mean_pa_pitches"))
    return p.join(top, "game_pk", "left").join(a, "game_pk", "left").select("game_pk", "mean_speed", "mean_pa_pitches", "modal_category", P.share(F.col("modal_n"), F.col("n_categories")).alias("modal_rate"))


def settle_game_calls(calls: DataFrame, actuals: DataFrame, games: DataFrame) -> DataFrame:
    """Calls on whole games: moneyline, total, mean speed, mean pitches and commonest result."""
    g = games.where(P.is_final(F.col("status"))).select("game_pk", "home_score", "away_score").dropDuplicates(["game_pk"])
    r = calls.join(g, "game_pk").join(actuals, "game_pk", "left")
    m, line = F.col("market"), F.col("line")
    number = F.when(m == "game_total", (F.col("home_score") + F.col("away_score")).cast("double")).when(m == "pitch_speed_ou", F.col("mean_speed")).when(m == "ab_pitches_ou", F.col("mean_pa_pitches"))
    label = F.when(m == "game_moneyline", F.when(F.col("home_score") > F.col("away_score"), "home").when(F.col("home_score") < F.col("away_score"), "away").when(F.col("home_score") == F.col("away_score"), "tie")).when(m == "pitch_result", F.col("modal_category")).otherwise(F.when(number == line, "push").when(number > line, "over").when(number < line, "under"))
    result = F.when(F.col("recommendation").isNull() | label.isNull(), "void").when(label.isin("tie", "push"), "push").when(F.col("recommendation") == label, "win").otherwise("loss")
    r = r.withColumn("actual_label", label).withColumn("result", result)
    profit = F.when(F.col("result") == "win", P.win_profit(F.col("price"), F.lit(1.0))).when(F.col("result") == "loss", -1.0).otherwise(0.0)
    return r.select(*calls.columns, "result", "actual_label", number.alias("actual_value"), profit.alias("profit_units"))


def _tally(digits: int = 4) -> list[Column]:
    return [F.count("*").alias("n"), F.count("result").alias("n_graded"), *(F.count_if(F.col("result") == r).alias(f"{r}{'es' if r in ('loss', 'push') else 's'}") for r in ("win", "loss", "push")), F.round(F.avg("confidence"), digits).alias("mean_confidence"), F.round(F.avg("profit_units"), digits).alias("mean_profit_units")]


def accuracy_rollup(calls: DataFrame, day: str, since: Column | None = None, digits: int = 4) -> DataFrame:
    """Calls by day, market and model version."""
    c = calls.where("market is not null")
    c = c.where(F.col(day) >= since) if since is not None else c
    return c.groupBy(F.col(day).alias("day"), "market", F.coalesce("model_version", F.lit("")).alias("model_version")).agg(*_tally(digits))


def player_rollup(calls: DataFrame, at_bats: DataFrame, day: str, digits: int = 4) -> DataFrame:
    """Calls by day, player, role, market and version: each call counts for its pitcher and its batter."""
    pa = at_bats.select("game_pk", "at_bat_index", F.explode(F.array(F.struct(F.col("pitcher_id").alias("player_id"), F.lit("pitcher").alias("role")), F.struct(F.col("batter_id").alias("player_id"), F.lit("batter").alias("role")))).alias("x")).select("game_pk", "at_bat_index", "x.*").where("player_id is not null")
    return calls.where("market is not null and at_bat_index is not null").join(pa, ["game_pk", "at_bat_index"]).groupBy(F.col(day).alias("day"), "player_id", "role", "market", F.coalesce("model_version", F.lit("")).alias("model_version")).agg(*_tally(digits))


def record(calls: DataFrame) -> DataFrame:
    """Wins, losses, pushes, units and return on them, in all and by market (grouping sets)."""
    g = calls.where("result in ('win', 'loss', 'push')").withColumns({"u": F.lit(1.0), "p": F.coalesce("profit_units", F.lit(0.0))})
    r = g.groupingSets([[], ["market"]], "market").agg(F.count("*").alias("picks"), *(F.count_if(F.col("result") == k).alias(n) for k, n in (("win", "wins"), ("loss", "losses"), ("push", "pushes"))), F.round(F.sum("p"), 2).alias("units"), F.coalesce(F.round(F.try_divide(100 * F.sum("p"), F.sum("u")), 1), F.lit(0.0)).alias("roi"))
    return r.withColumn("market", F.coalesce("market", F.lit("all")))


def recent_days(calls: DataFrame, day: str, days: int = 30) -> DataFrame:
    """Rows of the last ``days`` days up to the newest one."""
    newest = calls.agg(F.max(day).alias("__newest"))
    return calls.join(F.broadcast(newest), F.col(day) > F.date_sub("__newest", days)).drop("__newest")


def summary(calls: DataFrame, keys: Sequence[str], digits: int = 2) -> DataFrame:
    """Counts and win share; pushes leave the divisor."""
    g = calls.groupBy(*keys).agg(*_tally(), F.round(F.sum(F.coalesce("profit_units", F.lit(0.0))), digits).alias("profit_units"))
    return g.select(*keys, "n", "n_graded", "wins", "losses", "pushes", P.share(F.col("wins"), F.col("wins") + F.col("losses"), 3).alias("win_rate"), "profit_units")


def pitch_coverage(pitches: DataFrame, calls: DataFrame, games: DataFrame) -> DataFrame:
    """By game: pitches thrown, and those called beforehand. The call about pitch n is stamped n - 1."""
    called = calls.where("market in ('pitch_speed_ou', 'pitch_result')").groupBy("game_pk", "at_bat_index", (F.col("pitch_number") + 1).alias("pitch_number")).agg(F.bool_or(F.col("market") == "pitch_speed_ou").alias("has_velo"), F.bool_or(F.col("market") == "pitch_result").alias("has_result"), F.lit(True).alias("called"))
    thrown = pitches.where("at_bat_index is not null and pitch_number is not null").select("game_pk", "at_bat_index", "pitch_number")
    j = thrown.join(called, ["game_pk", "at_bat_index", "pitch_number"], "left").join(games.select("game_pk", F.col("game_date").alias("official_date"), "status"), "game_pk")
    return j.groupBy("official_date", "game_pk", "status").agg(F.count("*").alias("pitches_thrown"), F.count_if("has_velo").alias("velo_called"), F.count_if("has_result").alias("result_called"), F.count_if(F.col("has_velo") & F.col("has_result")).alias("both_called"), F.count_if(F.col("called").isNull()).alias("uncalled"))


def pitch_coverage_daily(coverage: DataFrame, first: Column, last: Column) -> DataFrame:
    """The coverage of games by day, with the share of pitches that carry both calls."""
    sums = ["pitches_thrown", "velo_called", "result_called", "both_called", "uncalled"]
    d = coverage.where(F.col("official_date").between(first, last)).groupBy("official_date").agg(F.count("*").alias("games"), *(F.sum(c).alias(c) for c in sums))
    return d.withColumn("both_rate", P.share(F.col("both_called"), F.col("pitches_thrown")))


def backfilled_coverage(pitches: DataFrame, calls: DataFrame) -> DataFrame:
    """By game: pitches with a result call, and how many of the calls were made later."""
    pr = calls.where("market = 'pitch_result' and pitch_number is not null").select("game_pk", "at_bat_index", (F.col("pitch_number") + 1).alias("pitch_number"), F.col("backfilled").alias("was_backfilled")).distinct()
    j = pitches.select("game_pk", "at_bat_index", "pitch_number").join(pr, ["game_pk", "at_bat_index", "pitch_number"], "left")
    g = j.groupBy("game_pk").agg(F.count("*").alias("pitches"), F.count("was_backfilled").alias("covered"), F.count_if("was_backfilled").alias("backfilled"))
    return g.withColumn("pct_covered", F.round(F.try_divide(100.0 * F.col("covered"), F.col("pitches").cast("double")), 1))


def market_coverage(games: DataFrame, calls: DataFrame, expected: int) -> DataFrame:
    """By day: games with all, some and none of the expected markets called."""
    seen = calls.groupBy("game_pk").agg(F.countDistinct("market").alias("markets"))
    j = games.join(seen, "game_pk", "left").withColumn("markets", F.coalesce("markets", F.lit(0)))
    return j.groupBy(F.col("game_date").alias("official_date")).agg(F.count("*").alias("games"), F.count_if(F.col("markets") >= expected).alias("full_cov"), F.count_if(F.col("markets").between(1, expected - 1)).alias("partial_cov"), F.count_if(F.col("markets") == 0).alias("zero_cov"), F.round(F.avg("markets"), 2).alias("avg_markets"))


def accuracy_series(rollup: DataFrame, digits: int = 4) -> DataFrame:
    """Days and markets over all versions: means weighted by graded calls."""
    weight = lambda c: F.round(F.try_divide(F.sum(F.col(c) * F.col("n_graded")), F.sum(F.when(F.col(c).isNotNull(), F.col("n_graded"))).cast("double")), digits)
    return rollup.groupBy("day", "market").agg(*(F.sum(c).alias(c) for c in ("n", "n_graded", "wins", "losses", "pushes")), weight("mean_confidence").alias("mean_confidence"), F.array_join(F.array_sort(F.collect_set("model_version")), ",").alias("versions"))


def recap_day(games: DataFrame, as_of: Column, back: int = 10) -> DataFrame:
    """The latest day within ``back`` days whose games are all over."""
    d = games.where(F.col("game_date").between(F.date_sub(as_of, back), as_of)).groupBy("game_date").agg(F.bool_and(P.is_final(F.col("status"))).alias("over"), F.count("*").alias("games"))
    return d.where("over").agg(F.max("game_date").alias("day"), F.max_by("games", "game_date").alias("games"))


def first_and_last(df: DataFrame, keys: Sequence[str], order: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    """First and last row of each key, and the number of its rows, in one aggregation."""
    row, place = F.struct(*columns), F.struct(*order)
    g = df.groupBy(*keys).agg(F.min_by(row, place).alias("first"), F.max_by(row, place).alias("last"), F.count("*").alias("n_rows"))
    return g.select(*keys, *(F.col(f"first.{c}").alias(f"first_{c}") for c in columns), *(F.col(f"last.{c}").alias(f"last_{c}") for c in columns), "n_rows")


def call_pairs(calls: DataFrame) -> DataFrame:
    """One row for each position, with its class call and its speed call side by side."""
    g = calls.groupBy("game_pk", "at_bat_index", "pitch_number")
    pick = lambda market, c: F.max(F.when(F.col("market") == market, F.col(c)))
    return g.agg(pick("pitch_result", "recommendation").alias("class_call"), pick("pitch_result", "confidence").alias("class_confidence"), pick("pitch_speed_ou", "recommendation").alias("speed_call"), pick("pitch_speed_ou", "line").alias("speed_line"))


def plate_appearance_summary(calls: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Right and graded calls of each plate appearance, the mean miss of the speed line, and the pitches it took."""
    g = calls.groupBy("game_pk", "at_bat_index").agg(F.count_if(F.col("result") == "win").alias("right"), F.count_if(F.col("result").isin("win", "loss")).alias("graded"), F.round(F.avg(F.abs(F.col("actual_value") - F.col("line"))), 4).alias("mean_miss"))
    return at_bats.select("game_pk", "at_bat_index", "pitch_count").join(g, ["game_pk", "at_bat_index"], "left").select("game_pk", "at_bat_index", F.coalesce("right", F.lit(0)).cast("long").alias("right"), F.coalesce("graded", F.lit(0)).cast("long").alias("graded"), "mean_miss", "pitch_count")


def accuracy_by_count(calls: DataFrame, pitches: DataFrame, min_samples: int = 6, most: int = 8) -> DataFrame:
    """The best-sampled counts and how often calls on the pitch thrown in them were right."""
    on = pitches.select("game_pk", "at_bat_index", (F.col("pitch_number") - 1).alias("pitch_number"), F.concat_ws("-", "balls", "strikes").alias("count_state"))
    j = calls.where("result in ('win', 'loss')").join(on, ["game_pk", "at_bat_index", "pitch_number"])
    g = j.groupBy("count_state").agg(F.count("*").alias("graded"), F.count_if(F.col("result") == "win").alias("right")).where(F.col("graded") >= min_samples)
    return g.withColumn("accuracy", P.share(F.col("right"), F.col("graded"))).orderBy(F.desc("graded"), "count_state").limit(most)


def daily_delta(series: DataFrame, last_days: int = 14) -> DataFrame:
    """Win share of the last days of each market, with the change from the day before."""
    w = Window.partitionBy("market").orderBy("day")
    s = series.withColumn("accuracy", P.share(F.col("wins"), F.col("wins") + F.col("losses"))).where("accuracy is not null")
    s = s.withColumns({"delta": F.round(F.col("accuracy") - F.lag("accuracy").over(w), 4), "__n": F.row_number().over(Window.partitionBy("market").orderBy(F.desc("day")))})
    return s.where(F.col("__n") <= last_days).select("market", "day", "accuracy", "delta")
