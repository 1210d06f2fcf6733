"""Nested play-by-play documents to flat pitch and plate-appearance rows.

One exchange by game serves every carried-forward value: windows share the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Call codes of the feed and what they describe.
CALL_CODES = {
    "B": "ball", "*B": "ball", "I": "ball", "P": "ball", "V": "ball", "H": "hit_by_pitch",
    "C": "called_strike", "A": "called_strike", "S": "swinging_strike", "W": "swinging_strike", "M": "swinging_strike", "Q": "swinging_strike",
    "F": "foul", "T": "foul", "L": "foul", "O": "foul", "R": "foul", "X": "in_play", "D": "in_play", "E": "in_play", "J": "in_play",
}
STRIKEOUTS = ("strikeout", "strikeout_double_play", "strikeout_triple_play")
WALKS = ("walk", "intent_walk", "hit_by_pitch")
HITS = ("single", "double", "triple", "home_run")

_ID = "struct<id:bigint>"
_CODE = "struct<code:string>"
PLAYS = (
    "struct<allPlays:array<struct<"
    "result:struct<eventType:string,event:string,homeScore:int,awayScore:int,rbi:int>,"
    "about:struct<atBatIndex:int,inning:int,isTopInning:boolean,isScoringPlay:boolean>,"
    "count:struct<outs:int>,"
    f"matchup:struct<pitcher:{_ID},batter:{_ID},batSide:{_CODE},pitchHand:{_CODE},postOnFirst:{_ID},postOnSecond:{_ID},postOnThird:{_ID}>,"
    f"playEvents:array<struct<type:string,pitchNumber:int,startTime:string,count:struct<balls:int,strikes:int>,details:struct<call:{_CODE},description:string,type:{_CODE},isStrike:boolean,isBall:boolean,isInPlay:boolean>,"
    "pitchData:struct<startSpeed:double,endSpeed:double,zone:int,extension:double,plateTime:double,strikeZoneTop:double,strikeZoneBottom:double,coordinates:struct<pX:double,pZ:double>,breaks:struct<spinRate:int,spinDirection:int,breakAngle:double,breakLength:double,breakHorizontal:double,breakVerticalInduced:double>>,"
    "hitData:struct<launchSpeed:double,launchAngle:double,totalDistance:double,trajectory:string,hardness:string,location:string,coordinates:struct<coordX:double,coordY:double>>>>>>>"
)


def describe_call(code: Column, text: Column) -> Column:
    """What a call code stands for, else the feed's own words with underscores."""
    codes = F.create_map(*(F.lit(x) for kv in CALL_CODES.items() for x in kv))
    own = F.nullif(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit(" "), F.lit("_")), F.lit(""))
    return F.coalesce(F.try_element_at(codes, code), own)


def result_category(description: Column) -> Column:
    """ball, strike_foul or in_play: by the whole word, then its start, then parts."""
    d = F.lower(description)
    return (
        F.when(d.isin("called_strike", "swinging_strike", "foul"), "strike_foul")
        .when(d.isin("ball", "hit_by_pitch"), "ball")
        .when(d.startswith("in_play") | d.contains("in play"), "in_play")
        .when(d.contains("strike") | d.contains("foul"), "strike_foul")
        .when(d.contains("ball") | d.contains("pitchout"), "ball")
    )


def plate_appearance_result(event: Column) -> Column:
    e = F.lower(event)
    return F.when(e.isin(*STRIKEOUTS), "strikeout").when(e.isin(*WALKS), "walk").when(e.isin(*HITS), "hit").when(e.isNotNull() & (e != ""), "out")


def men_on_base(first: Column, second: Column, third: Column) -> Column:
    return F.when(first.isNotNull() & second.isNotNull() & third.isNotNull(), "Loaded").when(second.isNotNull() | third.isNotNull(), "RISP").when(first.isNotNull(), "Men_On").otherwise("Empty")


def plays(feed: DataFrame, json_col: str = "feed") -> DataFrame:
    """One row a play, with what holds before it: score, bases, and times this batter has met this pitcher.

    Bases clear when the half-inning changes. Every play moves bases and score,
    also those that are no plate appearance. A feed that does not parse gives no play.
    """
    p = feed.select("game_pk", "game_date", F.posexplode(F.from_json(json_col, PLAYS)["allPlays"]).alias("ord", "p"))
    w = Window.partitionBy("game_pk").orderBy("ord")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    scored = F.when(F.col("p.result.homeScore").isNotNull(), F.struct(F.col("p.result.homeScore").alias("home"), F.coalesce("p.result.awayScore", F.lit(0)).alias("away")))
    same_half = F.lag(F.struct("p.about.inning", "p.about.isTopInning")).over(w) == F.struct("p.about.inning", "p.about.isTopInning")
    base = lambda c: F.when(same_half, F.lag(f"p.matchup.{c}.id").over(w))
    met = F.row_number().over(Window.partitionBy("game_pk", "p.matchup.pitcher.id", "p.matchup.batter.id").orderBy("ord"))
    known = F.col("p.matchup.pitcher.id").isNotNull() & F.col("p.matchup.batter.id").isNotNull()
    out = p.select(
        "game_pk",
        "game_date",
        "ord",
        "p",
        F.last(scored, ignorenulls=True).over(before).alias("score"),
        base("postOnFirst").alias("on_first"),
        base("postOnSecond").alias("on_second"),
        base("postOnThird").alias("on_third"),
        F.when(known, met).alias("times_through_order"),
    )
    return out.select(
        "*",
        F.col("p.about.atBatIndex").alias("at_bat_index"),
        F.col("p.matchup.pitcher.id").alias("pitcher_id"),
        F.col("p.matchup.batter.id").alias("batter_id"),
        F.col("p.about.inning").alias("inning"),
        F.col("p.about.isTopInning").alias("top_inning"),
        F.col("p.matchup.batSide.code").alias("bat_side"),
        F.col("p.matchup.pitchHand.code").alias("pitch_hand"),
        F.coalesce("score.home", F.lit(0)).alias("home_score"),
        F.coalesce("score.away", F.lit(0)).alias("away_score"),
        men_on_base(F.col("on_first"), F.col("on_second"), F.col("on_third")).alias("men_on_base"),
        F.filter("p.playEvents", lambda e: e["type"] == "pitch").alias("pitches"),
    )


_CONTEXT = ["game_pk", "game_date", "at_bat_index", "pitcher_id", "batter_id", "inning", "top_inning", "men_on_base", "home_score", "away_score", "times_through_order", "bat_side", "pitch_hand"]


def flatten_pitches(feed: DataFrame, json_col: str = "feed", counts: str = "before") -> DataFrame:
    """One row a pitch. ``counts="before"`` carries the count the pitch was thrown in, ``"after"`` the feed's own."""
    e = plays(feed, json_col).select(*_CONTEXT, "ord", "on_first", "on_second", "on_third", F.col("p.count.outs").alias("outs"), F.posexplode("pitches").alias("n", "e"))
    pa = Window.partitionBy("game_pk", "ord").orderBy("n")
    count = lambda c: F.coalesce(F.lag(f"e.count.{c}").over(pa), F.lit(0)) if counts == "before" else F.coalesce(F.col(f"e.count.{c}"), F.lit(0))
    of_game = F.when(F.col("pitcher_id").isNotNull(), F.row_number().over(Window.partitionBy("game_pk", "pitcher_id").orderBy("ord", "n")))
    description = describe_call(F.col("e.details.call.code"), F.col("e.details.description"))
    named = {
        "pitch_type": "details.type.code", "is_strike": "details.isStrike", "is_ball": "details.isBall", "is_in_play": "details.isInPlay",
        "start_speed": "pitchData.startSpeed", "end_speed": "pitchData.endSpeed", "zone": "pitchData.zone", "plate_x": "pitchData.coordinates.pX", "plate_z": "pitchData.coordinates.pZ",
        "sz_top": "pitchData.strikeZoneTop", "sz_bottom": "pitchData.strikeZoneBottom", "spin_rate": "pitchData.breaks.spinRate", "spin_direction": "pitchData.breaks.spinDirection",
        "break_vertical_induced": "pitchData.breaks.breakVerticalInduced", "break_horizontal": "pitchData.breaks.breakHorizontal", "break_angle": "pitchData.breaks.breakAngle", "break_length": "pitchData.breaks.breakLength",
        "extension": "pitchData.extension", "plate_time": "pitchData.plateTime", "launch_speed": "hitData.launchSpeed", "launch_angle": "hitData.launchAngle", "total_distance": "hitData.totalDistance",
        "trajectory": "hitData.trajectory", "hit_hardness": "hitData.hardness", "hit_location": "hitData.location", "hit_coord_x": "hitData.coordinates.coordX", "hit_coord_y": "hitData.coordinates.coordY",
    }
    return e.select(
        *_CONTEXT, "outs", "on_first", "on_second", "on_third",
        F.col("e.pitchNumber").alias("pitch_number"), F.try_to_timestamp("e.startTime").alias("pitch_ts"), count("balls").alias("balls"), count("strikes").alias("strikes"),
        of_game.alias("pitch_of_game"), description.alias("description"), result_category(description).alias("result_category"),
        *(F.col(f"e.{path}").alias(name) for name, path in named.items()),
    )


def flatten_at_bats(feed: DataFrame, json_col: str = "feed") -> DataFrame:
    """One row a plate appearance: a play with an event."""
    p = plays(feed, json_col).where("p.result.eventType is not null and p.result.eventType <> ''")
    at = lambda i: F.try_to_timestamp(F.try_element_at("pitches", F.lit(i))["startTime"])
    return p.select(
        *_CONTEXT,
        F.coalesce(F.size("pitches"), F.lit(0)).alias("pitch_count"),
        plate_appearance_result(F.col("p.result.eventType")).alias("result"),
        F.col("p.result.eventType").alias("result_detail"),
        F.col("p.result.event").alias("event"),
        F.col("p.result.rbi").alias("rbi"),
        F.col("p.about.isScoringPlay").alias("is_scoring_play"),
        at(1).alias("start_ts"),
        at(-1).alias("end_ts"),
    )


def to_feed(pitches: DataFrame, at_bats: DataFrame) -> DataFrame:
    """Pitch rows nested back into one play-by-play document a game (game_pk, game_date, feed)."""
    event = F.struct(
        F.lit("pitch").alias("type"), F.col("pitch_number").alias("pitchNumber"), F.date_format("pitch_ts", "yyyy-MM-dd'T'HH:mm:ss").alias("startTime"),
        F.struct("balls", "strikes").alias("count"),
        F.struct(F.struct(F.when(F.col("description") == "ball", "B").when(F.col("description") == "called_strike", "C").when(F.col("description") == "swinging_strike", "S").when(F.col("description") == "foul", "F").alias("code")).alias("call"), F.replace(F.col("description"), F.lit("_"), F.lit(" ")).alias("description"), F.struct(F.col("pitch_type").alias("code")).alias("type"), F.col("is_ball").alias("isBall"), F.col("is_in_play").alias("isInPlay")).alias("details"),
        F.struct(F.col("start_speed").alias("startSpeed"), "zone").alias("pitchData"), F.struct(F.col("launch_speed").alias("launchSpeed"), F.col("launch_angle").alias("launchAngle")).alias("hitData"),
    )
    events = pitches.groupBy("game_pk", "at_bat_index").agg(F.array_sort(F.collect_list(F.struct("pitch_number", event.alias("e")))).alias("events"))
    on = lambda *states: F.struct(F.when(F.col("men_on_base").isin(*states), F.col("batter_id")).alias("id"))
    play = F.struct(
        F.struct(F.col("result_detail").alias("eventType"), F.when((F.col("game_pk") + F.col("at_bat_index")) % 5 != 0, F.col("at_bat_index") + 1).alias("homeScore"), F.lit(0).alias("awayScore")).alias("result"),
        F.struct(F.col("at_bat_index").alias("atBatIndex"), (1 + F.floor(F.col("at_bat_index") / 2)).cast("int").alias("inning"), F.lit(True).alias("isTopInning")).alias("about"),
        F.struct(F.struct(F.col("pitcher_id").alias("id")).alias("pitcher"), F.struct(F.col("batter_id").alias("id")).alias("batter"), F.struct(F.col("bat_side").alias("code")).alias("batSide"), F.struct(F.col("pitch_hand").alias("code")).alias("pitchHand"), on("Men_On", "Loaded").alias("postOnFirst"), on("RISP", "Loaded").alias("postOnSecond"), on("Loaded").alias("postOnThird")).alias("matchup"),
        F.transform("events", lambda x: x["e"]).alias("playEvents"),
    )
    p = at_bats.join(events, ["game_pk", "at_bat_index"])
    g = p.groupBy("game_pk").agg(F.min("game_date").alias("game_date"), F.array_sort(F.collect_list(F.struct("at_bat_index", play.alias("play")))).alias("plays"))
    return g.select("game_pk", "game_date", F.to_json(F.struct(F.transform("plays", lambda x: x["play"]).alias("allPlays"))).alias("feed"))
