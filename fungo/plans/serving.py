"""Serving views, joins and sorts over the pitch tables, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators import aggregates as A
from fungo.operators import grading as G
from fungo.plans.grading import _GRADED
from fungo.sources import datasets as D

DAY = "1996-05-01"
_KEY = ["game_pk", "at_bat_index", "pitch_number"]


def _games_of_day(t):
    return t.games.where(F.col("game_date").between(F.date_sub(F.lit(DAY).cast("date"), 30), F.lit(DAY).cast("date")))


_DAYS = f"g.game_date between date '{DAY}' - interval 30 day and date '{DAY}'"

PLANS = {
    "j8_call_about_pitch": (
        lambda t: t.pitches.select(*_KEY, "result_category").join(t.predictions.where("market = 'pitch_result'").select("game_pk", "at_bat_index", (F.col("pitch_number") + 1).alias("pitch_number"), F.col("recommendation")), _KEY, "left"),
        "select p.game_pk, p.at_bat_index, p.pitch_number, p.result_category, c.recommendation from pitches_v p left join predictions_v c on c.market = 'pitch_result' and c.game_pk = p.game_pk and c.at_bat_index = p.at_bat_index and c.pitch_number = p.pitch_number - 1",
    ),
    "j11_calls_of_finished_games": (
        lambda t: t.predictions.join(t.games.where("status = 'Final'").select("game_pk"), "game_pk", "left_semi").groupBy("market").agg(F.count("*").alias("n"), F.countDistinct("game_pk").alias("games")),
        "select market, count(*) as n, count(distinct game_pk) as games from predictions_v where game_pk in (select game_pk from games_v where status = 'Final') group by 1",
    ),
    "j13_situation_before_and_after": (
        lambda t: t.predictions.where("market = 'pitch_result'").select("id", *_KEY).join(t.pitches.select("game_pk", "at_bat_index", "pitch_number", F.col("balls").alias("balls_now"), F.col("strikes").alias("strikes_now")), _KEY, "left").join(t.pitches.select("game_pk", "at_bat_index", (F.col("pitch_number") - 1).alias("pitch_number"), F.col("result_category").alias("outcome")), _KEY, "left").select("id", F.when((F.col("pitch_number") == 0) & F.col("outcome").isNotNull(), "0-0").otherwise(F.concat("balls_now", F.lit("-"), "strikes_now")).alias("count_text"), "outcome"),
        "select c.id, case when c.pitch_number = 0 and a.result_category is not null then '0-0' else b.balls || '-' || b.strikes end as count_text, a.result_category as outcome from predictions_v c left join pitches_v b on b.game_pk = c.game_pk and b.at_bat_index = c.at_bat_index and b.pitch_number = c.pitch_number left join pitches_v a on a.game_pk = c.game_pk and a.at_bat_index = c.at_bat_index and a.pitch_number - 1 = c.pitch_number where c.market = 'pitch_result'",
    ),
    "j16_slate": (
        lambda t: _games_of_day(t).join(t.pitches.groupBy("game_pk").agg(F.max(F.struct("at_bat_index", "pitch_number", "balls", "strikes")).alias("s"), F.count("*").alias("pitches")), "game_pk", "left").join(t.predictions.groupBy("game_pk").agg(F.countDistinct("market").alias("markets"), F.max("confidence").alias("top_confidence")), "game_pk", "left").select("game_pk", "game_date", "status", "s.at_bat_index", "s.pitch_number", F.coalesce("pitches", F.lit(0)).cast("long").alias("pitches"), F.coalesce("markets", F.lit(0)).cast("long").alias("markets"), "top_confidence"),
        f"with s as (select game_pk, at_bat_index, pitch_number, count(*) over (partition by game_pk) as pitches from pitches_v qualify row_number() over (partition by game_pk order by at_bat_index desc, pitch_number desc) = 1), c as (select game_pk, count(distinct market) as markets, max(confidence) as top_confidence from predictions_v group by 1) select g.game_pk, g.game_date, g.status, s.at_bat_index, s.pitch_number, coalesce(s.pitches, 0) as pitches, coalesce(markets, 0) as markets, top_confidence from games_v g left join s on s.game_pk = g.game_pk left join c on c.game_pk = g.game_pk where {_DAYS}",
    ),
    "o3_board_order": (
        lambda t: _games_of_day(t).select("game_pk", F.when(F.col("status") == "In Progress", 0).otherwise(1).alias("phase"), (F.col("game_pk") % 17).alias("edge"), "game_date").orderBy("phase", F.desc("edge"), "game_date", "game_pk").limit(40),
        f"select game_pk, case when status = 'In Progress' then 0 else 1 end as phase, game_pk % 17 as edge, game_date from games_v g where {_DAYS} order by phase, edge desc, game_date, game_pk limit 40",
    ),
    "w10_newest_call_of_position": (
        lambda t: t.predictions.groupBy("game_pk", "market", "at_bat_index").agg(F.max_by(F.struct("id", "pitch_number", "recommendation"), "id").alias("r")).select("game_pk", "market", "at_bat_index", "r.*"),
        "select game_pk, market, at_bat_index, id, pitch_number, recommendation from predictions_v qualify row_number() over (partition by game_pk, market, at_bat_index order by id desc) = 1",
    ),
    "w12_preferred_scope": (
        lambda t: A.first_per_key(A.player_profiles(t.pitches, t.at_bats, "pitcher_id", 0), ["player_id"], [F.when(F.col("scope") == "season", 0).when(F.col("scope") == "d30", 1).otherwise(2)]).select("player_id", "scope", "pitches"),
        "with c as (select pitcher_id as player_id, 'career' as scope, 2 as r, count(*) as pitches from pitches_v group by 1 having count(*) >= 30 union all select pitcher_id, 'season', 0, count(*) from pitches_v where year(game_date) = (select year(max(game_date)) from pitches_v) group by 1 having count(*) >= 30) select player_id, scope, pitches from c qualify row_number() over (partition by player_id order by r) = 1",
    ),
    "p3_clamped_window": (
        lambda t: t.predictions.where(F.col("created_date").between(F.greatest(F.lit("1990-01-01").cast("date"), F.date_sub(F.lit(DAY).cast("date"), 21)), F.lit(DAY).cast("date"))).groupBy("created_date", "market").agg(F.count("*").alias("n")),
        f"select created_date, market, count(*) as n from predictions_v where created_date between greatest(date '1990-01-01', date '{DAY}' - 21) and date '{DAY}' group by 1, 2",
    ),
    "p6_gap_fill": (
        lambda t: _games_of_day(t).join(t.predictions.groupBy("game_pk").agg(F.countDistinct("market").alias("m")), "game_pk", "left").where(F.coalesce("m", F.lit(0)) < 2).select("game_pk", F.coalesce("m", F.lit(0)).cast("long").alias("markets")),
        f"with c as (select game_pk, count(distinct market) as m from predictions_v group by 1) select g.game_pk, coalesce(m, 0) as markets from games_v g left join c on c.game_pk = g.game_pk where {_DAYS} and coalesce(m, 0) < 2",
    ),
    "s7_recent_seasons": (lambda t: D.recent_seasons(t.games, 3), "select distinct cast(year(game_date) as int) as season from games_v order by season desc limit 3"),
    "s11_day_totals": (
        lambda t: D.day_checksums(t.pitches, D.KEYS["pitches"], exact=True),
        "select game_date as day, count(*) as rows, count(distinct game_pk) as games, sha256(array_to_string(list_sort(list(concat_ws('|', game_pk, at_bat_index, pitch_number))), chr(10))) as checksum from pitches_v group by 1",
    ),
    "s11_day_folds": (
        lambda t: D.day_checksums(t.pitches, D.KEYS["pitches"]),
        "select game_date as day, count(*) as rows, count(distinct game_pk) as games, cast(sum(('0x' || substr(md5(concat_ws('|', game_pk, at_bat_index, pitch_number)), 1, 12))::bigint) as varchar) as checksum from pitches_v group by 1",
    ),
    "s13_pending_days": (
        lambda t: D.pending_days(t.games.select(F.col("game_date").alias("day")), t.ledger.where("dataset = 'pitches' and games >= 7").select("day"), F.lit("1996-04-01").cast("date"), F.lit(DAY).cast("date"), most=1_000),
        f"select distinct game_date as day from games_v where game_date between date '1996-04-01' and date '{DAY}' and game_date not in (select day from ledger_v where dataset = 'pitches' and games >= 7)",
    ),
    "s17_upsert": (
        lambda t: D.upsert(t.games.select("game_pk", "status", "home_score").where("game_pk % 3 <> 0"), t.games.where("game_pk % 2 = 0").select("game_pk", F.lit("Final").alias("status"), (F.col("home_score") + 1).alias("home_score")), ["game_pk"], F.col("home_score")),
        "select game_pk, case when game_pk % 2 = 0 then 'Final' else status end as status, case when game_pk % 2 = 0 then home_score + 1 else home_score end as home_score from games_v where game_pk % 2 = 0 or game_pk % 3 <> 0",
    ),
    "s17_insert_ignore": (
        lambda t: D.new_rows(t.games.select("game_pk", "status").where("game_pk % 3 <> 0"), t.games.select("game_pk", F.lit("new").alias("status")).where("game_pk % 2 = 0"), ["game_pk"]),
        "select game_pk, case when game_pk % 3 <> 0 then status else 'new' end as status from games_v where game_pk % 2 = 0 or game_pk % 3 <> 0",
    ),
    "s19_prune": (
        lambda t: D.prune(t.predictions, "created_date", F.lit("1998-07-15").cast("date"), 21).groupBy("market").agg(F.count("*").alias("n")),
        "select market, count(*) as n from predictions_v where created_date >= date '1998-07-15' - 21 group by 1",
    ),
    "s20_prune_quotes": (
        lambda t: D.prune_quotes(t.odds, ["game_pk", "market", "source", "outcome"], F.lit("1998-07-15").cast("date")).select("id"),
        "select id from odds_v qualify fetched_at >= date '1998-07-15' - 14 or row_number() over (partition by game_pk, market, source, coalesce(outcome, '') order by fetched_at desc, id desc) = 1",
    ),
    "v1_profile_lookup": (
        lambda t: A.situational_splits(t.pitches, t.at_bats, 0).where("role = 'pitcher' and player_id = 7").select("men_on_base", "opp_hand", "pa", "k_rate").orderBy("men_on_base", "opp_hand"),
        "select men_on_base, bat_side as opp_hand, count(*) as pa, round(sum(cast(result = 'strikeout' as int)) / count(*), 4) as k_rate from at_bats_v where pitcher_id = 7 group by men_on_base, bat_side",
    ),
    "v2_matchup_lookup": (
        lambda t: A.matchup_lookup(t.pitches.select("pitcher_id", "batter_id"), A.matchup_history(t.at_bats, 0)),
        """with asked as (select distinct pitcher_id, batter_id from pitches_v),
 met as (select pitcher_id, batter_id, count(*) as n, sum(cast(result = 'hit' as int)) as hits from at_bats_v group by all)
select a.pitcher_id, a.batter_id, cast(case when n >= 3 then n else 0 end as bigint) as pa_count, cast(case when n >= 3 then hits else 0 end as bigint) as h_count from asked a left join met m on m.pitcher_id = a.pitcher_id and m.batter_id = a.batter_id""",
    ),
    "v15_speed_by_workload": (
        lambda t: t.pitches.groupBy("pitcher_id", F.when(F.col("pitch_of_game") <= 25, "1-25").when(F.col("pitch_of_game") <= 50, "26-50").when(F.col("pitch_of_game") <= 75, "51-75").otherwise("76+").alias("workload")).agg(F.count("*").alias("n"), F.round(F.avg("start_speed"), 8).alias("mean_speed")),
        "select pitcher_id, case when pitch_of_game <= 25 then '1-25' when pitch_of_game <= 50 then '26-50' when pitch_of_game <= 75 then '51-75' else '76+' end as workload, count(*) as n, round(avg(start_speed), 8) as mean_speed from pitches_v group by 1, 2",
    ),
    "v16_outcome_mix": (
        lambda t: t.at_bats.groupBy("batter_id").pivot("result", ["strikeout", "walk", "hit", "out"]).agg(F.count("game_pk")).na.fill(0).withColumn("pa", F.col("strikeout") + F.col("walk") + F.col("hit") + F.col("out")).orderBy(F.desc("pa"), "batter_id").limit(7),
        "select batter_id, count(*) filter (where result = 'strikeout') as strikeout, count(*) filter (where result = 'walk') as walk, count(*) filter (where result = 'hit') as hit, count(*) filter (where result = 'out') as out, count(*) as pa from at_bats_v group by 1 order by pa desc, batter_id limit 7",
    ),
    "v5_window_feed": (
        lambda t: G.settle_pitch_calls(t.predictions, t.pitches, t.games).join(_games_of_day(t).select("game_pk", "home_team_id", "away_team_id"), "game_pk").where("(home_team_id = 105 or away_team_id = 105) and result is not null").select("id", "game_pk", "market", "result", "home_team_id", "away_team_id"),
        f"with {_GRADED} select id, r.game_pk, market, result, home_team_id, away_team_id from graded r join games_v g on g.game_pk = r.game_pk where {_DAYS} and (home_team_id = 105 or away_team_id = 105) and result is not null",
    ),
    "f22_barrels": (
        lambda t: t.pitches.where(P.barrel()).groupBy("batter_id").agg(F.count("*").alias("barrels")),
        "select batter_id, count(*) as barrels from pitches_v where launch_speed >= 98 and launch_angle between 26 - (launch_speed - 98) and 30 + (launch_speed - 98) group by 1",
    ),
    "f17_win_profit": (
        lambda t: t.odds.select("id", P.win_profit(F.col("price_american"), F.lit(2.0)).alias("profit")),
        "select id, round(case when price_american > 0 then 2.0 * price_american / 100 else 2.0 * 100 / -price_american end, 3) as profit from odds_v",
    ),
    "f11_blend": (
        lambda t: t.pitches.groupBy("pitcher_id").agg(F.count("*").alias("n"), F.avg("start_speed").alias("v")).select("pitcher_id", F.round(P.blend(F.col("v"), 92.8, F.col("n"), 300.0), 7).alias("blended"), F.round(P.confidence(F.col("n"), 500.0), 7).alias("confidence")),
        "select pitcher_id, round(0.85::double * (1 - exp(-count(*) / 300)) * avg(start_speed) + (1 - 0.85::double * (1 - exp(-count(*) / 300))) * 92.8, 7) as blended, round(0.5::double + 0.32 * (1 - exp(-count(*) / 500)), 7) as confidence from pitches_v group by 1",
    ),
}

