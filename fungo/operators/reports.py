"""Views put together for readers: the board of a day, the graded feed, the coverage report and the state of the system."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators import grading as G

#: Hours after which a published table is stale.
STALE_HOURS = 36
LIVE = ("In Progress", "Delayed", "Suspended", "Warmup")


#: What the feed tells of a call itself.
CALLED = ("id", "official_date", "game_pk", "game_label", "at_bat_index", "pitch_number", "market", "recommendation", "predicted_value", "line", "confidence", "result", "actual_value", "actual_label", "profit_units", "backfilled")


def graded_feed(calls: DataFrame, games: DataFrame, at_bats: DataFrame, pitches: DataFrame, names: DataFrame | None = None, graded_only: bool = False) -> DataFrame:
    """Every call with its day, players, the situation it was made into, what was thrown next, and the signed miss.

    The situation is that of the pitch already thrown; before the first pitch of
    a plate appearance it is read off that first pitch, at 0-0. Where the pitch is
    not known it stays null. The day is the game's, not the call's instant.

    Calls, pitches and players of a plate appearance are put in one sequence, and a
    call finds the pitch at its own place and the one at the next by their numbers.
    So calls, the widest and most rows, go to their game and plate appearance at most
    (nowhere if all inputs lie by game) and never to a position or player. Names join
    the plate appearances, which are fewer.
    """
    kept = calls.where(F.col("result").isNotNull()) if graded_only else calls
    slate = games.groupBy("game_pk").agg(F.max("game_date").alias("official_date"), F.max(F.concat_ws(" @ ", F.col("away_team_id").cast("string"), F.col("home_team_id").cast("string"))).alias("game_label"))
    players = at_bats.where("at_bat_index is not null").groupBy("game_pk", "at_bat_index").agg(F.min("pitcher_id").alias("pitcher_id"), F.min("batter_id").alias("batter_id"))
    who = ["pitcher_id", "batter_id"]
    if names is not None:
        known = names.where("player_id is not null").groupBy("player_id").agg(F.min("full_name").alias("full_name"))
        for role in ("pitcher", "batter"):
            players = players.join(known.select(F.col("player_id").alias(f"{role}_id"), F.col("full_name").alias(f"{role}_name")), f"{role}_id", "left")
        who += ["pitcher_name", "batter_name"]
        players = players.repartition("game_pk")  # as the calls lie by now, so that they stay where they are
    call = kept.join(slate, "game_pk").select(*CALLED, F.lit(True).alias("__call"))
    place = ["game_pk", "at_bat_index"]
    thrown = pitches.where("at_bat_index is not null and pitch_number is not null").select(*place, "pitch_number", F.struct("inning", "top_inning", "balls", "strikes", "outs", "pitch_type").alias("__thrown"))
    both = call.unionByName(thrown, allowMissingColumns=True).unionByName(players.select(*place, F.struct(*who).alias("__who")), allowMissingColumns=True)
    w = Window.partitionBy(*place).orderBy("pitch_number")
    found = {"at": F.max("__thrown").over(w.rangeBetween(0, 0)), "next": F.max("__thrown").over(w.rangeBetween(1, 1)), "who": F.max("__who").over(w.rangeBetween(Window.unboundedPreceding, Window.unboundedFollowing))}
    j = both.withColumns(found).where("__call")
    opener = F.col("pitch_number") == 0
    sit = F.coalesce("at", F.when(opener, F.col("next")))
    said = F.when(F.col("at").isNotNull(), F.concat_ws("-", F.coalesce("at.balls", F.lit(0)), F.coalesce("at.strikes", F.lit(0)))).when(opener & F.col("next").isNotNull(), "0-0")
    return j.select(
        *CALLED[:-2],
        F.round(F.col("predicted_value") - F.col("actual_value"), 2).alias("miss"),
        "profit_units",
        *(f"who.{c}" for c in who[:2]),
        sit["inning"].alias("inning"),
        F.when(sit["top_inning"], "top").when(~sit["top_inning"], "bottom").alias("half"),
        said.alias("count_text"),
        sit["outs"].alias("outs"),
        F.col("next.pitch_type").alias("next_pitch_type"),
        "backfilled",
        *(f"who.{c}" for c in who[2:]),
    )


def feed_summary(feed: DataFrame) -> DataFrame:
    """Calls, graded ones by result, and those made later, by day; calls made later count, and how many they are is told."""
    r = F.col("result")
    return feed.groupBy("official_date").agg(
        F.count("*").alias("n"), F.count("result").alias("graded"), *(F.count_if(r == k).alias(n) for k, n in (("win", "wins"), ("loss", "losses"), ("push", "pushes"))), F.count_if("backfilled").alias("backfilled"), F.countDistinct("game_pk").alias("games")
    )


def coverage_report(games: DataFrame, calls: DataFrame, pitches: DataFrame, expected: int, pregame: Column, first: Column, last: Column) -> DataFrame:
    """By day and in all: games with all, some and none of the markets, with all of them before the first pitch, and pitches that carry both calls.

    ``pregame`` tells a call made before the game. The row without a day is the total; its rates are of the sums.
    """
    window = games.where(F.col("game_date").between(first, last))
    seen = calls.groupBy("game_pk").agg(F.countDistinct("market").alias("markets"), F.countDistinct(F.when(pregame, F.col("market"))).alias("early"))
    per_game = window.select("game_pk", F.col("game_date").alias("official_date")).join(seen, "game_pk", "left").na.fill(0, ["markets", "early"])
    m = F.col("markets")
    days = per_game.groupBy("official_date").agg(F.count("*").alias("games"), F.count_if(m >= expected).alias("full_cov"), F.count_if(m.between(1, expected - 1)).alias("partial_cov"), F.count_if(m == 0).alias("zero_cov"), F.count_if(F.col("early") >= expected).alias("pregame_full"), F.sum(m).alias("markets"))
    thrown = G.pitch_coverage_daily(G.pitch_coverage(pitches, calls, games), first, last).drop("games", "both_rate")
    both = days.join(thrown, "official_date", "left")
    sums = [c for c in both.columns if c != "official_date"]
    whole = both.groupingSets([["official_date"], []], "official_date").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums))
    return whole.select("official_date", *(c for c in sums if c != "markets"), P.share(F.col("markets"), F.col("games"), 3).alias("avg_markets"), P.share(F.col("pregame_full"), F.col("games"), 3).alias("pregame_full_rate"), P.share(F.col("both_called"), F.col("pitches_thrown"), 3).alias("both_rate"))


def health(runs: DataFrame, registry: DataFrame, tables: Mapping[str, tuple[DataFrame, str]], now: Column) -> DataFrame:
    """Rows (section, name, detail, n, age, stale): the last success of each job, active models, and rows and age of each published table.

    ``runs``: job, finished_at, ok. A job that never succeeded has no age; a table
    without rows is stale. Ages are seconds for jobs and whole hours for tables.
    """
    age = lambda at: F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(at)
    none = {"string": F.lit(None).cast("string"), "long": F.lit(None).cast("long"), "boolean": F.lit(None).cast("boolean")}
    done = runs.groupBy("job").agg(F.count("*").alias("n"), F.max(F.when(F.col("ok"), F.col("finished_at").cast("timestamp"))).alias("at"))
    jobs = done.select(F.lit("job").alias("section"), F.col("job").alias("name"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("detail"), "n", age(F.col("at")).alias("age"), none["boolean"].alias("stale"))
    out = jobs.unionByName(registry.where("is_active").select(F.lit("model").alias("section"), F.col("market").alias("name"), F.col("version").alias("detail"), none["long"].alias("n"), none["long"].alias("age"), none["boolean"].alias("stale")))
    for name, (df, ts) in tables.items():
        one = df.agg(F.count("*").alias("n"), F.max(F.col(ts).cast("timestamp")).alias("at"))
        hours = F.round(age(F.col("at")) / 3600).cast("long")
        out = out.unionByName(one.select(F.lit("table").alias("section"), F.lit(name).alias("name"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("detail"), "n", hours.alias("age"), F.coalesce(hours > STALE_HOURS, F.lit(True)).alias("stale")))
    return out


def phase_of(status: Column) -> Column:
    """live, final or upcoming."""
    return F.when(P.is_final(status), "final").when(status.isin(*LIVE), "live").otherwise("upcoming")


def board(games: DataFrame, calls: DataFrame, day: Column) -> DataFrame:
    """The board of a day: its games by phase with their newest call of each market and best edge, and the record of the recap day before.

    Rows (section, place, game_pk, markets, best_market, best_edge, wins, losses).
    Live games come first, then upcoming and final ones, each by falling edge and
    number; ``place`` counts within a section. The recap is the last day before
    whose games are all over, with its graded calls.
    """
    newest = calls.groupBy("game_pk", "market").agg(F.max_by(F.struct("edge", "result"), "id").alias("c")).select("game_pk", "market", "c.*")
    best = newest.groupBy("game_pk").agg(F.count("*").alias("markets"), F.max_by("market", F.struct("edge", "market")).alias("best_market"), F.max("edge").alias("best_edge"))
    slate = games.where(F.col("game_date") == day).join(best, "game_pk", "left").select(phase_of(F.col("status")).alias("section"), "game_pk", F.coalesce("markets", F.lit(0)).alias("markets"), "best_market", "best_edge")
    place = F.row_number().over(Window.partitionBy("section").orderBy(F.desc_nulls_last("best_edge"), "game_pk"))
    rows = slate.select("section", place.cast("int").alias("place"), "game_pk", "markets", "best_market", "best_edge", F.lit(None).cast("long").alias("wins"), F.lit(None).cast("long").alias("losses"))
    past = G.recap_day(games, F.date_sub(day, 1))
    over = games.join(F.broadcast(past.select("day").where("day is not null")), F.col("game_date") == F.col("day"), "left_semi").select("game_pk")  # one row
    graded = calls.join(over, "game_pk", "left_semi").agg(F.count_if(F.col("result") == "win").alias("wins"), F.count_if(F.col("result") == "loss").alias("losses"))
    recap = graded.select(F.lit("recap").alias("section"), F.lit(1).alias("place"), F.lit(None).cast("long").alias("game_pk"), F.lit(0).cast("long").alias("markets"), F.lit(None).cast("string").alias("best_market"), F.lit(None).cast("double").alias("best_edge"), "wins", "losses")
    return recap.unionByName(rows)

