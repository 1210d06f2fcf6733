"""Market rows, edge boards, picks, preferred rows and slates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fungo.functions import predicates as P

# The least edge and chance of a pick, and how many picks a day shows.
LEAST_MONEYLINE_EDGE, LEAST_RESULT_CHANCE, LEAST_FAIR_CHANCE, SHOWN = 0.04, 0.52, 0.58, 50
PICK_KEYS = ("pick_date", "game_pk", "market", "at_bat_index", "recommendation")


def full_quote(quotes: DataFrame) -> DataFrame:
    """Quotes with the missing one of implied probability and American price worked out from the other."""
    return quotes.withColumns({
        "implied_prob": F.coalesce("implied_prob", P.american_to_probability(F.col("price_american"))),
        "price_american": F.coalesce("price_american", P.probability_to_american(F.col("implied_prob"))),
    })


def line_rows(calls: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``calls`` (keys, predicted_value, confidence) with side, line, price and edge against one quote each.

    ``quotes``: keys, line, over_price, under_price. The side is the one on which
    the prediction lies; without a line or a prediction all four stay null.
    """
    both = calls.join(quotes.select(*keys, F.col("line").cast("double").alias("line"), "over_price", "under_price"), list(keys), "left")
    known = F.col("line").isNotNull() & F.col("predicted_value").isNotNull()
    over = F.col("predicted_value") > F.col("line")
    price = F.when(known, F.when(over, F.col("over_price")).otherwise(F.col("under_price")))
    return both.select(
        *calls.columns,
        F.when(known, F.when(over, "over").otherwise("under")).alias("recommendation"),
        F.when(known, F.col("line")).alias("line"),
        price.alias("price"),
        F.round(F.col("confidence") - P.american_to_probability(price), 4).alias("edge"),
    )


def class_rows(calls: DataFrame, probs: str = "probs") -> DataFrame:
    """``calls`` with the likeliest class of a map of chances; ties go to the first name."""
    entries = F.array_sort(F.transform(F.map_entries(probs), lambda e: F.struct((-e["value"]).alias("down"), e["key"].alias("name"))))
    top = F.try_element_at(entries, F.lit(1))
    return calls.withColumns({"recommendation": top["name"], "predicted_value": -top["down"]})


def source_rows(calls: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each call and source: the side that the prediction takes of that source's own line, and its edge.

    ``quotes``: keys, source, outcome (over, under), line, price_american,
    implied_prob. A source without a line, or without a priced quote of that
    side, has no row.
    """
    lines = quotes.where("line is not null").groupBy(*keys, "source").agg(F.min("line").alias("own_line"))
    told = calls.join(lines, list(keys)).withColumn("outcome", F.when(F.col("predicted_value") > F.col("own_line"), "over").otherwise("under"))
    priced = quotes.where("implied_prob is not null").select(*keys, "source", "outcome", "price_american", "implied_prob")
    edge = F.round(F.col("confidence") - F.col("implied_prob"), 4)
    return told.join(priced, [*keys, "source", "outcome"]).select(*keys, "source", F.col("outcome").alias("recommendation"), F.col("own_line").alias("line"), F.col("price_american").alias("price"), "implied_prob", edge.alias("edge"))


def best_sources(calls: DataFrame, quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every call with its best source by edge (ties go to the last name), and the number of sources; null where none prices it."""
    best = F.max_by(F.struct("recommendation", "line", "price", "edge", F.col("source").alias("best_source")), F.struct("edge", "source"))
    board = source_rows(calls, quotes, keys).groupBy(*keys).agg(best.alias("b"), F.count("*").alias("sources"))
    return calls.join(board, list(keys), "left").select(*calls.columns, "b.*", F.coalesce("sources", F.lit(0)).alias("sources"))


def external_rows(quotes: DataFrame, calls: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Quotes of markets that no call covers, without an edge."""
    return quotes.join(calls.select(*keys).distinct(), list(keys), "left_anti").select(*keys, "source", "outcome", "price_american", "implied_prob", F.lit(None).cast("double").alias("edge"))


def live_picks(moneyline: DataFrame, results: DataFrame, lines: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Picks of open positions, each once by date, game, market, plate appearance and side.

    ``moneyline``: edges of a side; ``results``: chances of a class, taken at the
    start of the plate appearance only; ``lines``: sides of a model's own line at
    even money. All hold the columns of a pick and ``pitch_count_pa``. Picks that
    ``known`` holds already are left out.
    """
    parts = [
        moneyline.where(F.col("edge") >= LEAST_MONEYLINE_EDGE),
        results.where((F.col("confidence") >= LEAST_RESULT_CHANCE) & (F.col("pitch_count_pa") <= 1) & F.col("recommendation").isin("strikeout", "walk", "hit")).withColumns({"edge": F.round(F.col("confidence") - 0.5, 4), "price": F.lit(None).cast("int")}),
        lines.where((F.col("confidence") >= LEAST_FAIR_CHANCE) & F.col("recommendation").isNotNull()).withColumn("price", F.lit(100)),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    first = F.min_by(F.struct("price", "confidence", "edge"), F.struct(F.col("pitch_count_pa"), -F.col("confidence")))
    picks = out.groupBy(*PICK_KEYS).agg(first.alias("p")).select(*PICK_KEYS, "p.*")
    if known is not None:
        same = [picks[c].eqNullSafe(known[c]) for c in PICK_KEYS]
        picks = picks.join(known, same, "left_anti")
    return picks


def picks_of_day(picks: DataFrame, day: Column, n: int = SHOWN) -> DataFrame:
    """The day's picks of greatest edge (a top-k report), ties by game and side."""
    return picks.where(F.col("pick_date") == day).orderBy(F.desc_nulls_last("edge"), "game_pk", "recommendation").limit(n)


def preferred(rows: DataFrame, keys: Sequence[str], kind: str, order: Sequence[str], newest: str) -> DataFrame:
    """One row a key: of the kind that stands first in ``order``, and of those the newest."""
    rank = F.coalesce(F.array_position(F.array(*(F.lit(x) for x in order)), F.col(kind)), F.lit(0))
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(rank, -F.col(newest))).alias("r")).select(*keys, "r.*")


def quoted_games(quotes: DataFrame, games: DataFrame) -> DataFrame:
    """``quotes`` (game_date, away_team_id, home_team_id) with the game they are of and how it was found.

    Both teams name a game by pair; one team alone names its game of the day, the
    greatest number where it plays twice. Quotes of no game stay, with nulls.
    """
    day = F.col("game_date").alias("__day")
    pairs = games.groupBy(day, F.col("away_team_id").alias("__away"), F.col("home_team_id").alias("__home")).agg(F.max("game_pk").alias("__pair"))
    teams = games.select(day, "game_pk", F.explode(F.array("home_team_id", "away_team_id")).alias("__team")).groupBy("__day", "__team").agg(F.max("game_pk").alias("__single"))
    by_pair = (F.col("game_date") == F.col("__day")) & (F.col("away_team_id") == F.col("__away")) & (F.col("home_team_id") == F.col("__home"))
    found = quotes.join(pairs, by_pair, "left").drop("__day", "__away", "__home")
    alone = F.when(F.col("home_team_id").isNull() | F.col("away_team_id").isNull(), F.coalesce("home_team_id", "away_team_id"))
    found = found.withColumn("__alone", alone).join(teams, (F.col("game_date") == F.col("__day")) & (F.col("__alone") == F.col("__team")), "left")
    return found.select(*quotes.columns, F.coalesce("__pair", "__single").alias("game_pk"), F.when(F.col("__pair").isNotNull(), "pair").when(F.col("__single").isNotNull(), "team").alias("matched_by"))


def in_window(games: DataFrame, now: Column, live: DataFrame, hours: int = 4) -> DataFrame:
    """Games within ``hours`` of their start, and those that are live still."""
    open_ = (F.col("start_ts") <= now) & (now < F.col("start_ts") + F.make_dt_interval(hours=F.lit(hours)))
    marked = games.join(live.select("game_pk").distinct().withColumn("is_live", F.lit(True)), "game_pk", "left")
    return marked.where(open_ | F.coalesce("is_live", F.lit(False))).select(*games.columns, F.coalesce("is_live", F.lit(False)).alias("is_live"))


def slate(games: DataFrame, day: Column, calls: DataFrame) -> DataFrame:
    """Games of a day with the number of calls on each, by market, and the best edge; ordered for display."""
    counts = calls.groupBy("game_pk").agg(F.count("*").alias("calls"), F.countDistinct("market").alias("markets"), F.max("confidence").alias("top_confidence"))
    return games.where(F.col("game_date") == day).join(counts, "game_pk", "left").na.fill(0, ["calls", "markets"])


def observed(pairs: DataFrame, pitches: DataFrame) -> DataFrame:
    """Positions with both calls against the pitch that followed: whether each was right, null where it cannot be told."""
    seen = pitches.select("game_pk", "at_bat_index", (F.col("pitch_number") - 1).alias("pitch_number"), "start_speed", "result_category")
    speed = F.when(F.col("start_speed") > F.col("speed_line"), "over").when(F.col("start_speed").isNotNull() & F.col("speed_line").isNotNull(), "under")
    both = pairs.join(seen, ["game_pk", "at_bat_index", "pitch_number"], "left")
    return both.select(*pairs.columns, (F.col("class_call") == F.col("result_category")).alias("class_right"), (F.col("speed_call") == speed).alias("speed_right"))


def recent_record(calls: DataFrame, n: int = 12) -> DataFrame:
    """The newest graded calls (a top-k report)."""
    return calls.where("result in ('win', 'loss', 'push')").orderBy(F.desc("created_date"), F.desc("id")).limit(n)
