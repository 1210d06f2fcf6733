"""Leak-free rolling form, and weighted training cells."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fungo.functions import predicates as P

#: Days that each trailing window looks back; None is all of history.
WINDOWS: dict[str, int | None] = {"career": None, "d30": 30, "d90": 90}

# What features are centred on, in training and in scoring alike, and the widths of their buckets.
ZONE_BASE, ZONE_STEP = 0.48, 0.03
STRIKEOUT_BASE, STRIKEOUT_STEP = 0.221, 0.035
SPEED_BASE, SPEED_STEP = 92.8, 0.5
MOST_REMAINING = 12


def form_spine(events: DataFrame, entity: str, day: str, measures: Mapping[str, Column], null_safe: bool = False, windows: Mapping[str, int | None] = WINDOWS) -> DataFrame:
    """Trailing means of each measure for every (entity, day), the day itself left out.

    Events are summed to (entity, day) first, so windows run over days and a
    busy entity costs no more than its days. Means are weighted by events; a
    day's mean is kept to nine decimals, so that sums do not depend on order.
    ``null_safe`` weighs a measure by the events that have it; without it a day
    without the measure still counts in the divisor.
    """
    daily = events.groupBy(entity, day).agg(F.count("*").alias("n"), *(F.round(F.avg(c), 9).cast("decimal(18,9)").alias(f"m_{k}") for k, c in measures.items()), *(F.count(c).alias(f"n_{k}") for k, c in measures.items()))
    order = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(entity).orderBy(order)
    out: list[Column] = [F.col(entity), F.col(day)]
    for name, back in windows.items():
        frame = w.rangeBetween(Window.unboundedPreceding if back is None else -back, -1)
        out.append(F.coalesce(F.sum("n").over(frame), F.lit(0)).alias(f"{name}_n"))
        for k in measures:
            weight = F.col(f"n_{k}") if null_safe else F.col("n")
            out.append(F.try_divide(F.sum(F.col(f"m_{k}") * weight.cast("decimal(12,0)")).over(frame).cast("double"), F.nullif(F.sum(weight).over(frame), F.lit(0)).cast("double")).alias(f"{name}_{k}"))
    return daily.select(*out)


def pitch_spine(pitches: DataFrame, **how) -> DataFrame:
    """Zone share and speed of each pitcher up to the day before."""
    return form_spine(pitches, "pitcher_id", "game_date", {"zone_rate": F.when(P.in_zone(), 1.0).otherwise(0.0), "velo": F.col("start_speed")}, **how)


def at_bat_spine(at_bats: DataFrame, **how) -> DataFrame:
    """Strikeout share of each pitcher up to the day before."""
    return form_spine(at_bats, "pitcher_id", "game_date", {"k_rate": F.when(F.col("result") == "strikeout", 1.0).otherwise(0.0)}, **how)


def weighted_cells(facts: DataFrame, spine: DataFrame, keys: Sequence[Column], feature: str, base: float, step: float, bucket: str, extra: Sequence[Column] = ()) -> DataFrame:
    """Facts counted in cells of their keys and the form bucket of every window at once."""
    known = spine.where("career_n > 0").select("pitcher_id", "game_date", *(F.col(f"{w}_{feature}").alias(f"__{w}") for w in WINDOWS))
    joined = facts.join(known, ["pitcher_id", "game_date"])
    return joined.groupBy(F.year("game_date").alias("season"), *keys, *(P.step_bucket(F.col(f"__{w}"), base, step).alias(f"{w}_{bucket}") for w in WINDOWS)).agg(*extra, F.count("*").alias("n"))


def pitch_result_cells(pitches: DataFrame) -> DataFrame:
    outcome = F.when(F.col("is_in_play"), "in_play").when(F.col("is_ball"), "ball").otherwise("strike_foul")
    return weighted_cells(pitches, pitch_spine(pitches), [F.col("balls"), F.col("strikes"), outcome.alias("outcome")], "zone_rate", ZONE_BASE, ZONE_STEP, "zone_bucket")


def at_bat_result_cells(at_bats: DataFrame) -> DataFrame:
    """Cells at the start of the plate appearance: the count is 0-0 throughout."""
    outcome = F.when(F.col("result").isin("strikeout", "walk", "hit", "out"), F.col("result")).otherwise("out")
    return weighted_cells(at_bats, at_bat_spine(at_bats), [F.lit(0).alias("balls"), F.lit(0).alias("strikes"), outcome.alias("outcome")], "k_rate", STRIKEOUT_BASE, STRIKEOUT_STEP, "zone_bucket")


def pitch_speed_cells(pitches: DataFrame, digits: int = 6) -> DataFrame:
    keys = [F.col("balls"), F.col("strikes"), F.least(F.col("pitch_number"), F.lit(10)).alias("pitch_of_pa")]
    extra = [F.round(F.avg("start_speed"), digits).alias("mean_speed"), F.round(F.coalesce(F.var_pop("start_speed"), F.lit(0.0)), digits).alias("var_speed")]
    return weighted_cells(pitches.where("start_speed is not null"), pitch_spine(pitches), keys, "velo", SPEED_BASE, SPEED_STEP, "velo_bucket", extra)


def remaining_pitch_cells(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Pitches still to come, counted before the pitch at hand, by count."""
    pa = at_bats.where("pitch_count between 1 and 30").select("game_pk", "at_bat_index", "pitch_count")
    s = pitches.join(pa, ["game_pk", "at_bat_index"]).where("pitch_number <= pitch_count and balls between 0 and 3 and strikes between 0 and 2")
    remaining = F.least(F.col("pitch_count") - F.col("pitch_number") + 1, F.lit(MOST_REMAINING)).alias("remaining")
    return s.groupBy(F.year("game_date").alias("season"), "balls", "strikes", remaining).agg(F.count("*").alias("n"))


def moneyline_cells(games: DataFrame) -> DataFrame:
    g = games.where("home_score is not null and away_score is not null and home_score <> away_score")
    return g.groupBy("season", F.lit(0).alias("balls"), F.lit(0).alias("strikes"), F.when(F.col("home_score") > F.col("away_score"), 1).otherwise(0).alias("home_win")).agg(F.count("*").alias("n"))


def count_before_pitch(pitches: DataFrame) -> DataFrame:
    """The count as the pitch before left it (0-0 for the first of a plate appearance)."""
    w = Window.partitionBy("game_pk", "at_bat_index").orderBy("pitch_number")
    return pitches.withColumns({f"pre_{c}": F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("balls", "strikes")})


def clamped_pitch_result_cells(pitches: DataFrame, min_rows: int = 100) -> DataFrame:
    """Older form of the pitch cells: season-long rates, nearest buckets within two steps, counts before the pitch."""
    known = pitches.where("zone is not null")
    zone = known.groupBy("pitcher_id").agg(P.rate(P.in_zone(), None).alias("zr"), F.count("*").alias("c")).where(F.col("c") >= min_rows).drop("c")
    chase = known.groupBy("batter_id").agg(F.try_divide(F.count_if(P.swung() & P.out_of_zone()).cast("double"), F.count_if(P.out_of_zone()).cast("double")).alias("cr"), F.count("*").alias("c")).where(F.col("c") >= min_rows).drop("c")
    s = count_before_pitch(pitches).where("result_category is not null and pre_balls between 0 and 3 and pre_strikes between 0 and 2").join(zone, "pitcher_id", "left").join(chase, "batter_id", "left")
    return s.groupBy(F.col("pre_balls").alias("balls"), F.col("pre_strikes").alias("strikes"), P.near_bucket(F.col("zr"), 0.48, 0.03).alias("zone_bucket"), P.near_bucket(F.col("cr"), 0.28, 0.04).alias("chase_bucket"), F.col("result_category").alias("outcome")).agg(F.count("*").alias("n"))


def clamped_at_bat_cells(pitches: DataFrame, at_bats: DataFrame, min_rows: int = 50) -> DataFrame:
    """Older form of the plate-appearance cells: 0-0 and every count after a pitch that did not end it."""

    def strikeouts(player: str, name: str) -> DataFrame:
        return at_bats.groupBy(player).agg(P.rate(F.col("result") == "strikeout", None).alias(name), F.count("*").alias("c")).where(F.col("c") >= min_rows).drop("c")

    start = at_bats.select("pitcher_id", "batter_id", "bat_side", "pitch_hand", "result", F.lit(0).alias("balls"), F.lit(0).alias("strikes"))
    pa = at_bats.select("game_pk", "at_bat_index", "pitcher_id", "batter_id", "bat_side", "pitch_hand", "result", "pitch_count")
    later = pitches.select("game_pk", "at_bat_index", "pitch_number", "balls", "strikes").join(pa, ["game_pk", "at_bat_index"]).where("pitch_number < pitch_count and balls between 0 and 3 and strikes between 0 and 2").select(*start.columns)
    s = start.unionByName(later).where("result is not null").join(strikeouts("pitcher_id", "pk"), "pitcher_id", "left").join(strikeouts("batter_id", "bk"), "batter_id", "left")
    same = F.coalesce((F.col("pitch_hand") == F.col("bat_side")).cast("int"), F.lit(0))
    return s.groupBy("balls", "strikes", P.near_bucket(F.col("pk"), 0.221, 0.035).alias("pk_bucket"), P.near_bucket(F.col("bk"), 0.221, 0.035).alias("bk_bucket"), same.alias("platoon_same"), F.col("result").alias("outcome")).agg(F.count("*").alias("n"))


def clamped_speed_cells(pitches: DataFrame, min_fast: int = 50, min_rows: int = 20, digits: int = 6) -> DataFrame:
    """Older form of the speed cells: nearest whole speed of the pitcher's fastball, counts before the pitch."""
    known = pitches.where("start_speed is not null")
    fast = known.groupBy("pitcher_id").agg(F.avg(F.when(P.fastball(), F.col("start_speed"))).alias("fb"), F.count_if(P.fastball()).alias("c")).where(F.col("c") >= min_fast).drop("c")
    s = count_before_pitch(known).where("pre_balls between 0 and 3 and pre_strikes between 0 and 2").join(fast, "pitcher_id")
    g = s.groupBy(F.round("fb").alias("velo_bucket"), F.col("pre_balls").alias("balls"), F.col("pre_strikes").alias("strikes"), F.least("pitch_number", F.lit(8)).alias("pitch_of_pa"))
    return g.agg(F.count("*").alias("n"), F.round(F.avg("start_speed"), digits).alias("mean_speed"), F.round(F.var_samp("start_speed"), digits).alias("var_speed")).where(F.col("n") >= min_rows)


def clamped_remaining_cells(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Older form of the remaining-pitch cells: counted after the pitch at hand."""
    start = at_bats.where("pitch_count > 0").select(F.lit(0).alias("balls"), F.lit(0).alias("strikes"), F.col("pitch_count").alias("remaining"))
    pa = at_bats.select("game_pk", "at_bat_index", "pitch_count")
    later = pitches.join(pa, ["game_pk", "at_bat_index"]).where("pitch_number < pitch_count and balls between 0 and 3 and strikes between 0 and 2").select("balls", "strikes", (F.col("pitch_count") - F.col("pitch_number")).alias("remaining"))
    return start.unionByName(later).where("remaining >= 1").groupBy("balls", "strikes", F.least("remaining", F.lit(MOST_REMAINING)).alias("remaining")).agg(F.count("*").alias("n"))
