"""Figures as they stood before a day: nothing of the day itself or later enters them.

Events are summed to (entity, day). Days that are asked for are put among them as
empty days, and one ordered pass an entity gives every frame at once, so a call
meets the figures before its own day without a join on an inequality.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.operators import aggregates as A

#: A frame: so many days back, the season so far ("season"), the season so far and so many whole ones before it, or everything (None).
Frame = int | str | tuple[str, int] | None


def sums_before(daily: DataFrame, keys: Sequence[str], day: str, asked: DataFrame, sums: Sequence[str], frames: Mapping[str, Frame]) -> DataFrame:
    """For each asked (keys, day) the sums of the days before it, a column ``<frame>_<sum>`` each; 0 where there are none."""
    blank = asked.select(*keys, day).where(" and ".join(f"{c} is not null" for c in [*keys, day])).distinct()
    kinds = {f.name: f.dataType for f in daily.schema}
    rows = daily.select(*keys, day, *sums, F.lit(False).alias("__asked")).unionByName(blank.select(*keys, day, *(F.lit(0).cast(kinds[s]).alias(s) for s in sums), F.lit(True).alias("__asked")))
    days = rows.groupBy(*keys, day).agg(*(F.sum(s).alias(s) for s in sums), F.max("__asked").alias("__asked"))
    order, year = F.datediff(F.col(day), F.lit("1970-01-01").cast("date")), F.year(day)
    out: list[Column] = []
    for name, frame in frames.items():
        if frame is None or isinstance(frame, int):
            w = Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding if frame is None else -frame, -1)
        elif frame == "season":
            w = Window.partitionBy(*keys, year).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)
        else:
            # a day's number within its season, seasons 1000 apart: the frame begins at the first day of an earlier season
            place = year * 1000 + F.dayofyear(day)
            w = Window.partitionBy(*keys).orderBy(place)
            for s in sums:
                running = F.sum(s).over(w.rangeBetween(Window.unboundedPreceding, -1))
                out.append((F.coalesce(running, F.lit(0)) - F.coalesce(_until_season(keys, year, s, frame[1]), F.lit(0))).alias(f"{name}_{s}"))
            continue
        out += [F.coalesce(F.sum(s).over(w), F.lit(0)).alias(f"{name}_{s}") for s in sums]
    return days.select(*keys, day, *out, "__asked").where("__asked").drop("__asked")


def _until_season(keys: Sequence[str], year: Column, column: str, back: int) -> Column:
    """Sum of all seasons more than ``back`` before this one."""
    return F.sum(column).over(Window.partitionBy(*keys).orderBy(year).rangeBetween(Window.unboundedPreceding, -back - 1))


def player_days(pitches: DataFrame, at_bats: DataFrame, player: str, day: str = "game_date") -> DataFrame:
    """Sums of pitches and of plate appearances of each player and day."""
    p, a = A.pitch_days(pitches, player, day), A.plate_days(at_bats, player, day)
    return p.join(a, [player, day], "full").na.fill(0).select(player, day, *(F.coalesce(c, F.lit(0)).alias(c) for c in (*A.PITCH_SUMS, *A.PLATE_SUMS)))


def rolling_before(pitches: DataFrame, at_bats: DataFrame, player: str, asked: DataFrame, days: int = 30, min_pitches: int = 30, speed_digits: int = 1) -> DataFrame:
    """A player's rates over the ``days`` before each asked (player, game_date); a row only where there are ``min_pitches``."""
    sums = sums_before(player_days(pitches, at_bats, player), [player], "game_date", asked, [*A.PITCH_SUMS, *A.PLATE_SUMS], {"r": days})
    return sums.where(F.col("r_thrown") >= min_pitches).select(player, "game_date", *A.rolling_columns("r_", speed_digits))


def profile_before(pitches: DataFrame, at_bats: DataFrame, asked: DataFrame, order: Sequence[str] = ("season", "d30", "career"), min_pitches: int = 30) -> DataFrame:
    """Strikeout and walk rate of a pitcher before each asked day, in the first scope of ``order`` that has ``min_pitches``."""
    frames: dict[str, Frame] = {"season": "season", "d30": 30, "career": None}
    sums = sums_before(player_days(pitches, at_bats, "pitcher_id"), ["pitcher_id"], "game_date", asked, ["thrown", *A.PLATE_SUMS], {k: frames[k] for k in order})
    found = F.coalesce(*(F.when(F.col(f"{k}_thrown") >= min_pitches, F.struct(F.lit(k).alias("scope"), F.col(f"{k}_pa").alias("pa"), *(c.alias(n) for n, c in A.outcomes(f"{k}_").items()))) for k in order))
    return sums.select("pitcher_id", "game_date", found.alias("p")).where("p is not null").select("pitcher_id", "game_date", "p.*")


def team_rates_before(games: DataFrame, asked: DataFrame, digits: int = 3) -> DataFrame:
    """Games, runs for and against and win share of each team over finished regular games of the season before each asked (team_id, game_date)."""
    done = games.where(F.col("status").startswith("Final") & (F.col("game_type") == "R") & F.col("home_score").isNotNull() & F.col("away_score").isNotNull())
    side = lambda us, them: F.struct(F.col(f"{us}_team_id").alias("team_id"), F.col(f"{us}_score").alias("runs"), F.col(f"{them}_score").alias("allowed"))
    sides = done.select("game_date", F.explode(F.array(side("home", "away"), side("away", "home"))).alias("s")).select("game_date", "s.*").where("team_id is not null")
    daily = sides.groupBy("team_id", "game_date").agg(F.count("*").alias("n"), F.sum("runs").alias("runs"), F.sum("allowed").alias("allowed"), F.count_if(F.col("runs") > F.col("allowed")).alias("won"))
    s = sums_before(daily, ["team_id"], "game_date", asked, ["n", "runs", "allowed", "won"], {"s": "season"})
    per = lambda c, d: F.round(F.try_divide(F.col(f"s_{c}").cast("double"), F.col("s_n").cast("double")), d)
    return s.select("team_id", "game_date", F.col("s_n").alias("games"), per("runs", digits).alias("rs_pg"), per("allowed", digits).alias("ra_pg"), per("won", 4).alias("win_pct"))


def park_factors_before(games: DataFrame, asked: DataFrame, seasons: int = 3, prior: int = 200) -> DataFrame:
    """Runs at each venue against the league's over this season so far and ``seasons`` before it, for each asked (venue_id, game_date)."""
    scored = games.where("venue_id is not null and home_score is not null and away_score is not null")
    daily = scored.groupBy("venue_id", "game_date").agg(F.count("*").alias("n"), F.sum(F.col("home_score") + F.col("away_score")).alias("runs"))
    frame: dict[str, Frame] = {"v": ("seasons", seasons)}
    venue = sums_before(daily, ["venue_id"], "game_date", asked, ["n", "runs"], frame).where("v_n > 0")
    # the league has one row a day; all of it is one key
    league = daily.groupBy(F.lit(0).alias("league"), "game_date").agg(F.sum("n").alias("n"), F.sum("runs").alias("runs"))
    days = asked.select(F.lit(0).alias("league"), "game_date")
    whole = sums_before(league, ["league"], "game_date", days, ["n", "runs"], {"l": ("seasons", seasons)}).drop("league")
    mean = lambda k: F.try_divide(F.col(f"{k}_runs").cast("double"), F.col(f"{k}_n").cast("double"))
    factor = 1 + (F.try_divide(mean("v"), F.nullif(mean("l"), F.lit(0.0))) - 1) * (F.col("v_n") / (F.col("v_n") + prior))
    return venue.join(whole, "game_date").select("venue_id", "game_date", F.col("v_n").alias("games"), F.round(factor, 4).alias("factor"))
