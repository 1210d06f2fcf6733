"""Schedules, people and quotes from landed JSON documents to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.sources.play_by_play import result_category

_TEAM = "struct<score:int,team:struct<id:int,name:string,abbreviation:string>,probablePitcher:struct<id:int,fullName:string>>"
SCHEDULE = f"struct<dates:array<struct<games:array<struct<gamePk:bigint,officialDate:string,season:string,gameType:string,gameDate:string,status:struct<detailedState:string>,teams:struct<home:{_TEAM},away:{_TEAM}>,venue:struct<id:int,name:string>>>>>>"
BOXSCORE = "struct<officials:array<struct<officialType:string,official:struct<id:int,fullName:string>>>,info:array<struct<label:string,value:string>>>"
PEOPLE = "struct<people:array<struct<id:int,fullName:string,batSide:struct<code:string>,pitchHand:struct<code:string>,primaryPosition:struct<abbreviation:string>,mlbDebutDate:string,birthDate:string>>>"
SCOREBOARD = "struct<events:array<struct<competitions:array<struct<competitors:array<struct<homeAway:string,team:struct<abbreviation:string,displayName:string>>>,odds:array<struct<provider:struct<name:string>,homeTeamOdds:struct<moneyLine:int>,awayTeamOdds:struct<moneyLine:int>,overUnder:double,overOdds:int,underOdds:int>>>>>>>"
CONTRACTS = "struct<markets:array<struct<ticker:string,title:string,yes_sub_title:string,yes_bid:int,yes_ask:int,last_price:int>>>"
BOOKS = "array<struct<home_team:string,away_team:string,bookmakers:array<struct<key:string,markets:array<struct<key:string,outcomes:array<struct<name:string,price:int,point:double>>>>>>>>"


def schedule_games(docs: DataFrame, json_col: str = "doc", final_only: bool = False) -> DataFrame:
    """One row a scheduled game, as often as the schedule lists it."""
    g = docs.select(F.explode(F.from_json(json_col, SCHEDULE)["dates"]).alias("d")).select(F.explode("d.games").alias("g"))
    out = g.select(
        F.col("g.gamePk").alias("game_pk"), F.to_date("g.officialDate").alias("game_date"), F.col("g.season").try_cast("int").alias("season"), F.col("g.gameType").alias("game_type"), F.col("g.status.detailedState").alias("status"),
        *(F.col(f"g.teams.{s}.team.{c}").alias(f"{s}_{n}") for s in ("home", "away") for c, n in (("id", "team_id"), ("name", "team"), ("abbreviation", "abbr"))),
        *(F.col(f"g.teams.{s}.score").alias(f"{s}_score") for s in ("home", "away")),
        F.col("g.venue.id").alias("venue_id"), F.col("g.venue.name").alias("venue_name"), F.try_to_timestamp("g.gameDate").alias("start_ts"),
    )
    return out.where(P.is_final(F.col("status"))) if final_only else out


def probable_starters(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """Announced starters of each scheduled game: (game_pk, home_pitcher_id, home_pitcher, away_pitcher_id, away_pitcher); null where a side has none.

    A game that the schedule lists again keeps what any of its entries announces; of two names for a side the later document's stays.
    """
    g = docs.select(F.monotonically_increasing_id().alias("n"), F.explode(F.from_json(json_col, SCHEDULE)["dates"]).alias("d")).select("n", F.posexplode("d.games").alias("i", "g"))
    rows = g.where("g.gamePk is not null")
    last = lambda s: F.max_by(F.when(F.col(f"g.teams.{s}.probablePitcher.id").isNotNull(), F.col(f"g.teams.{s}.probablePitcher")), F.when(F.col(f"g.teams.{s}.probablePitcher.id").isNotNull(), F.struct("n", "i")))
    found = rows.groupBy(F.col("g.gamePk").alias("game_pk")).agg(*(last(s).alias(s) for s in ("home", "away")))
    return found.select("game_pk", *(F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in ("home", "away") for c, n in (("id", "pitcher_id"), ("fullName", "pitcher"))))


def boxscore_context(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """Home-plate umpire, weather, wind, attendance and duration of each game (game_pk)."""
    b = docs.select("game_pk", F.from_json(json_col, BOXSCORE).alias("b"))
    plate = F.try_element_at(F.filter("b.officials", lambda o: o["officialType"] == "Home Plate"), F.lit(-1))["official"]
    # the last of labels that repeat
    info = lambda label: F.rtrim(F.try_element_at(F.filter("b.info", lambda i: i["label"] == label), F.lit(-1))["value"], F.lit("."))
    number = lambda c, unit: F.trim(F.replace(F.split_part(c, F.lit(","), F.lit(1)), F.lit(unit), F.lit(""))).try_cast("double").cast("int")
    rest = lambda c: F.nullif(F.trim(F.regexp_extract(c, r"^[^,]*,(.*)$", 1)), F.lit(""))
    time = F.split(info("T"), ":")
    return b.select(
        "game_pk", plate["id"].alias("hp_umpire_id"), plate["fullName"].alias("hp_umpire"),
        rest(info("Weather")).alias("weather_condition"), number(info("Weather"), "degrees").alias("temp_f"), number(info("Wind"), "mph").alias("wind_mph"), rest(info("Wind")).alias("wind_direction"),
        F.replace(info("Att"), F.lit(","), F.lit("")).try_cast("int").alias("attendance"),
        F.when(F.size(time) == 2, F.get(time, F.lit(0)).try_cast("int") * 60 + F.get(time, F.lit(1)).try_cast("int")).alias("game_duration_min"),
    )


def people(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """One row a person with an id."""
    p = docs.select(F.explode(F.from_json(json_col, PEOPLE)["people"]).alias("p")).where("p.id is not null")
    return p.select(F.col("p.id").alias("player_id"), F.col("p.fullName").alias("full_name"), F.col("p.batSide.code").alias("bat_side"), F.col("p.pitchHand.code").alias("pitch_hand"), F.col("p.primaryPosition.abbreviation").alias("position"), F.to_date("p.mlbDebutDate").alias("debut_date"), F.to_date("p.birthDate").alias("birth_date"))


def team_of_text(texts: DataFrame, aliases: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """The team whose longest alias stands in each text; aliases (team_id, alias) are a small fixed list."""
    low = F.lower(text_col)
    hit = texts.join(F.broadcast(aliases), low.contains(F.lower("alias")), "left")
    return hit.groupBy(id_col).agg(F.max_by("team_id", F.struct(F.length("alias"), -F.col("team_id"))).alias("team_id"))


def scoreboard_quotes(docs: DataFrame, json_col: str = "doc", source: str = "board") -> DataFrame:
    """Moneyline and total quotes by side: away, home (abbreviations), market, outcome, line, price, implied_prob."""
    c = docs.select(F.explode(F.from_json(json_col, SCOREBOARD)["events"]).alias("e")).select(F.get("e.competitions", F.lit(0)).alias("c"))
    team = lambda s: F.try_element_at(F.filter("c.competitors", lambda x: x["homeAway"] == s), F.lit(1))["team"]["abbreviation"]
    o = c.select(team("away").alias("away"), team("home").alias("home"), F.get("c.odds", F.lit(0)).alias("o")).where("o is not null")
    side = lambda m, out, line, price: F.struct(F.lit(m).alias("market"), F.lit(out).alias("outcome"), line.cast("double").alias("line"), F.col(price).cast("int").alias("price_american"))
    no_line, line = F.lit(None), F.col("o.overUnder")
    sides = F.array(side("game_moneyline", "home", no_line, "o.homeTeamOdds.moneyLine"), side("game_moneyline", "away", no_line, "o.awayTeamOdds.moneyLine"), side("game_total", "over", line, "o.overOdds"), side("game_total", "under", line, "o.underOdds"))
    q = o.select("away", "home", F.coalesce("o.provider.name", F.lit(source)).alias("provider"), F.explode(sides).alias("q")).select("away", "home", "provider", "q.*")
    q = q.where("(market = 'game_moneyline' and price_american is not null) or (market = 'game_total' and line is not null)")
    return q.withColumns({"source": F.lit(source), "implied_prob": F.round(P.american_to_probability(F.col("price_american")), 4)})


def contract_quotes(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """Prediction-market contracts: the middle of bid and ask, else the last price; sure things are left out."""
    m = docs.select(F.explode(F.from_json(json_col, CONTRACTS)["markets"]).alias("m")).select("m.*")
    quoted = F.col("yes_bid").isNotNull() & F.col("yes_ask").isNotNull() & ((F.col("yes_bid") != 0) | (F.col("yes_ask") != 0))
    p = F.when(quoted, (F.col("yes_bid") + F.col("yes_ask")) / 200).when(F.col("last_price") != 0, F.col("last_price") / 100)
    q = m.select("ticker", F.coalesce("yes_sub_title", "title").alias("team_text"), p.alias("p")).where("team_text <> '' and p > 0 and p < 1")
    return q.select("ticker", "team_text", F.round("p", 4).alias("implied_prob"), P.probability_to_american(F.col("p")).alias("price_american"))


def bookmaker_quotes(docs: DataFrame, json_col: str = "doc") -> DataFrame:
    """One source a bookmaker: head-to-head and total quotes."""
    g = docs.select(F.explode(F.from_json(json_col, BOOKS)).alias("g"))
    b = g.select("g.home_team", "g.away_team", F.explode("g.bookmakers").alias("b")).select("home_team", "away_team", F.col("b.key").alias("source"), F.explode("b.markets").alias("m"))
    o = b.select("home_team", "away_team", "source", F.col("m.key").alias("kind"), F.explode("m.outcomes").alias("o"))
    outcome = F.when(F.col("kind") == "h2h", F.when(F.col("o.name") == F.col("home_team"), "home").when(F.col("o.name") == F.col("away_team"), "away")).when(F.col("kind") == "totals", F.lower("o.name"))
    q = o.select("home_team", "away_team", "source", F.when(F.col("kind") == "h2h", "game_moneyline").otherwise("game_total").alias("market"), outcome.alias("outcome"), F.when(F.col("kind") == "totals", F.col("o.point")).alias("line"), F.col("o.price").alias("price_american"))
    return q.where("outcome is not null").withColumn("implied_prob", F.round(P.american_to_probability(F.col("price_american")), 4))


# Column names of tracking files, by the name they get here.
TRACKING = {
    "game_pk": "game_pk", "at_bat_index": "at_bat_number", "pitch_number": "pitch_number", "pitcher_id": "pitcher", "batter_id": "batter",
    "zone": "zone", "balls": "balls", "strikes": "strikes", "outs": "outs_when_up", "inning": "inning",
}


def tracking_rows(raw: DataFrame) -> DataFrame:
    """Pitch rows of a tracking file; those without a speed go, and numbers that do not parse are null."""
    out = raw.select(
        *(F.expr(f"try_cast(`{old}` as bigint)").alias(new) for new, old in TRACKING.items()),
        "pitch_type",
        F.expr("try_cast(release_speed as double)").alias("start_speed"),
        "description",
        F.coalesce(F.col("inning_topbot") == "Top", F.lit(False)).alias("top_inning"),
        F.expr("try_cast(game_date as timestamp)").alias("pitch_ts"),
    )
    return out.where("start_speed is not null").withColumn("result_category", result_category(F.col("description")))
