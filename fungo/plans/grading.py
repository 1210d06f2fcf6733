"""Queries over settlement, rollups, coverage and record, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import grading as G

_KEY = "at_bat_index * 1000 + pitch_number"
_NEXT = f"""
nxt as (select p.*, n.start_speed, n.result_category, n.k is not null as found from (select *, {_KEY} as pk from predictions_v) p
  asof left join (select game_pk, {_KEY} as k, start_speed, result_category from pitches_v) n on p.game_pk = n.game_pk and p.pk < n.k)"""
_GRADED = f"""{_NEXT},
lab as (select nxt.*, g.status, case when market = 'pitch_speed_ou' then case when start_speed > line then 'over' when start_speed is not null then 'under' end else result_category end as label from nxt left join games_v g on g.game_pk = nxt.game_pk),
res as (select *, case when not found then case when status = 'Final' then 'void' end when label is null then 'void' when recommendation = label then 'win' else 'loss' end as result from lab),
graded as (select *, case result when 'win' then round(case when price > 0 then price / 100.0 when price < 0 then 100.0 / -price else 1.0 end, 3) when 'loss' then -1.0 when 'void' then 0.0 end as profit_units,
  case when result in ('win','loss') and market = 'pitch_speed_ou' then start_speed end as actual_value, case when result in ('win','loss') then label end as actual_label from res)"""

_TALLY = "count(*) as n, count(result) as n_graded, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes"
_MEANS = "round(avg(confidence), 8) as mean_confidence, round(avg(profit_units), 8) + 0.0 as mean_profit_units"
_ROLL = f"rollup_v as (select created_date as day, market, model_version, {_TALLY}, {_MEANS} from graded group by 1, 2, 3)"
_COVER = """
called as (select game_pk, at_bat_index, pitch_number, bool_or(market = 'pitch_speed_ou') as has_velo, bool_or(market = 'pitch_result') as has_result from predictions_v group by 1, 2, 3),
cover as (select g.game_date as official_date, t.game_pk, g.status, count(*) as pitches_thrown, count(*) filter (where has_velo) as velo_called, count(*) filter (where has_result) as result_called,
  count(*) filter (where has_velo and has_result) as both_called, count(*) filter (where c.game_pk is null) as uncalled
  from pitches_v t join games_v g on g.game_pk = t.game_pk left join called c on c.game_pk = t.game_pk and c.at_bat_index = t.at_bat_index and c.pitch_number = t.pitch_number - 1 group by 1, 2, 3)"""
_ACTUAL = """
cat as (select game_pk, result_category, count(*) as c from pitches_v group by 1, 2),
act as (select p.game_pk, p.mean_speed, a.mean_pa_pitches, t.modal_category, round(t.c / p.n, 4) as modal_rate
 from (select game_pk, round(avg(start_speed), 2) as mean_speed, count(result_category) as n from pitches_v group by 1) p
 left join (select game_pk, result_category as modal_category, c from cat qualify row_number() over (partition by game_pk order by c desc, result_category) = 1) t on t.game_pk = p.game_pk
 left join (select game_pk, round(avg(pitch_count), 2) as mean_pa_pitches from at_bats_v group by 1) a on a.game_pk = p.game_pk)"""
_GAME_CALLS = """select game_pk, m.market, case when m.market = 'game_moneyline' then case when game_pk % 2 = 0 then 'home' else 'away' end when m.market = 'pitch_result' then case cast(game_pk % 3 as int) when 0 then 'ball' when 1 then 'strike_foul' else 'in_play' end else case when game_pk % 4 < 2 then 'over' else 'under' end end as recommendation,
 case m.market when 'game_total' then 9.0 when 'pitch_speed_ou' then 90.5 when 'ab_pitches_ou' then 2.5 end as line, case cast(game_pk % 3 as int) when 0 then -110 when 1 then 120 else null end as price
from games_v cross join (select 'game_moneyline' as market union all select 'game_total' union all select 'pitch_speed_ou' union all select 'ab_pitches_ou' union all select 'pitch_result') m"""


def _settled(t):
    return G.settle_pitch_calls(t.predictions, t.pitches, t.games)


def _rollup(t):
    return G.accuracy_rollup(_settled(t), "created_date", digits=8)


def _day(x: str):
    return F.lit(x).cast("date")


PLANS = {
    "j7_next_event": (
        lambda t: G.next_event(t.predictions.select("id", "game_pk", "at_bat_index", "pitch_number"), t.pitches, ["game_pk"], ["at_bat_index", "pitch_number"], ["start_speed", "result_category"]),
        f"with {_NEXT} select id, game_pk, at_bat_index, pitch_number, found as next_found, start_speed as next_start_speed, result_category as next_result_category from nxt",
    ),
    "k1_settle_pitch_calls": (
        lambda t: _settled(t).select("id", "market", "recommendation", "status", "result", "profit_units", "actual_value", "actual_label"),
        f"with {_GRADED} select id, market, recommendation, status, result, profit_units, actual_value, actual_label from graded",
    ),
    "k2_settle_game_calls": (
        lambda t: G.settle_game_calls(t.sql(_GAME_CALLS), G.game_actuals(t.pitches, t.at_bats), t.games).select("game_pk", "market", "result", "actual_label", "profit_units"),
        f"""
with {_ACTUAL}, calls as ({_GAME_CALLS}),
 x as (select c.*, case c.market when 'game_total' then home_score + away_score when 'pitch_speed_ou' then mean_speed when 'ab_pitches_ou' then mean_pa_pitches end as num, home_score, away_score, modal_category
  from calls c join games_v g on g.game_pk = c.game_pk and g.status = 'Final' left join act on act.game_pk = c.game_pk),
 y as (select *, case market when 'game_moneyline' then case when home_score > away_score then 'home' when home_score < away_score then 'away' else 'tie' end when 'pitch_result' then modal_category
  else case when num = line then 'push' when num > line then 'over' when num < line then 'under' end end as actual_label from x),
 z as (select *, case when actual_label is null then 'void' when actual_label in ('tie','push') then 'push' when recommendation = actual_label then 'win' else 'loss' end as result from y)
select game_pk, market, result, actual_label, case result when 'win' then round(case when price > 0 then price / 100.0 when price < 0 then 100.0 / -price else 1.0 end, 3) when 'loss' then -1.0 else 0.0 end as profit_units from z""",
    ),
    "k3_fill_actuals": (
        lambda t: G.fill_actuals(_settled(t).withColumns({"actual_value": F.lit(None).cast("double"), "actual_label": F.lit(None).cast("string")}).drop("status"), t.pitches, t.games),
        f"with {_GRADED} select id, actual_value, actual_label from graded where result in ('win','loss') and status = 'Final'",
    ),
    "a18_accuracy_rollup": (_rollup, f"with {_GRADED}, {_ROLL} select * from rollup_v"),
    "a19_player_rollup": (
        lambda t: G.player_rollup(_settled(t), t.at_bats, "created_date", digits=8),
        f"""
with {_GRADED}, x as (select g.*, a.pitcher_id as player_id, 'pitcher' as role from graded g join at_bats_v a on a.game_pk = g.game_pk and a.at_bat_index = g.at_bat_index
 union all select g.*, a.batter_id, 'batter' from graded g join at_bats_v a on a.game_pk = g.game_pk and a.at_bat_index = g.at_bat_index)
select created_date as day, player_id, role, market, model_version, {_TALLY}, {_MEANS} from x group by 1, 2, 3, 4, 5""",
    ),
    "a20_record": (
        lambda t: G.record(_settled(t)),
        f"with {_GRADED} select coalesce(market, 'all') as market, count(*) as picks, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes, round(sum(profit_units), 2) as units, round(100 * sum(profit_units) / count(*), 1) as roi from graded where result in ('win','loss','push') group by grouping sets ((), (market))",
    ),
    "a20_record_of_30_days": (
        lambda t: G.record(G.recent_days(_settled(t), "created_date")),
        f"with {_GRADED} select coalesce(market, 'all') as market, count(*) as picks, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes, round(sum(profit_units), 2) as units, round(100 * sum(profit_units) / count(*), 1) as roi from graded where created_date > (select max(created_date) from graded) - interval 30 day and result in ('win','loss','push') group by grouping sets ((), (market))",
    ),
    "a21_market_coverage": (
        lambda t: G.market_coverage(t.games, t.predictions, 2),
        "with s as (select game_pk, count(distinct market) as m from predictions_v group by 1), j as (select g.game_date, coalesce(m, 0) as m from games_v g left join s on s.game_pk = g.game_pk) select game_date as official_date, count(*) as games, count(*) filter (where m >= 2) as full_cov, count(*) filter (where m between 1 and 1) as partial_cov, count(*) filter (where m = 0) as zero_cov, round(avg(m), 2) as avg_markets from j group by 1",
    ),
    "a22_pitch_coverage": (lambda t: G.pitch_coverage(t.pitches, t.predictions, t.games), f"with {_COVER} select * from cover"),
    "a22_pitch_coverage_daily": (
        lambda t: G.pitch_coverage_daily(G.pitch_coverage(t.pitches, t.predictions, t.games), _day("1995-01-01"), _day("1996-12-31")),
        f"with {_COVER} select official_date, count(*) as games, sum(pitches_thrown) as pitches_thrown, sum(velo_called) as velo_called, sum(result_called) as result_called, sum(both_called) as both_called, sum(uncalled) as uncalled, round(sum(both_called) / sum(pitches_thrown), 4) as both_rate from cover where official_date between date '1995-01-01' and date '1996-12-31' group by 1",
    ),
    "a23_backfilled_coverage": (
        lambda t: G.backfilled_coverage(t.pitches, t.predictions),
        "with pr as (select distinct game_pk, at_bat_index, pitch_number + 1 as pitch_number, backfilled from predictions_v where market = 'pitch_result') select p.game_pk, count(*) as pitches, count(pr.backfilled) as covered, count(*) filter (where pr.backfilled) as backfilled, round(100.0 * count(pr.backfilled) / count(*), 1) as pct_covered from pitches_v p left join pr on pr.game_pk = p.game_pk and pr.at_bat_index = p.at_bat_index and pr.pitch_number = p.pitch_number group by 1",
    ),
    "a24_summary": (
        lambda t: G.summary(_settled(t), ["market", "model_version"], 5),
        f"with {_GRADED} select market, model_version, {_TALLY}, round((count(*) filter (where result = 'win')) / nullif(count(*) filter (where result in ('win','loss')), 0), 3) as win_rate, round(sum(coalesce(profit_units, 0)), 5) as profit_units from graded group by 1, 2",
    ),
    "a25_accuracy_series": (
        lambda t: G.accuracy_series(_rollup(t), 6),
        f"with {_GRADED}, {_ROLL} select day, market, sum(n) as n, sum(n_graded) as n_graded, sum(wins) as wins, sum(losses) as losses, sum(pushes) as pushes, round(sum(mean_confidence * n_graded) / nullif(sum(n_graded), 0), 6) as mean_confidence, array_to_string(list_sort(list(distinct model_version)), ',') as versions from rollup_v group by 1, 2",
    ),
    "a26_recap_day": (
        lambda t: G.recap_day(t.games.withColumn("status", F.when(F.expr("game_pk % 50 = 0"), F.col("status")).otherwise("Final")), _day("1997-06-30")),
        "select max(game_date) as day, arg_max(games, game_date) as games from (select game_date, count(*) as games, bool_and(case when game_pk % 50 = 0 then status else 'Final' end = 'Final') as o from games_v where game_date between date '1997-06-20' and date '1997-06-30' group by 1) where o",
    ),
    "a29_pa_summary": (
        lambda t: G.plate_appearance_summary(_settled(t), t.at_bats),
        f"with {_GRADED} select a.game_pk, a.at_bat_index, count(*) filter (where g.result = 'win') as \"right\", count(*) filter (where g.result in ('win','loss')) as graded, round(avg(abs(actual_value - line)), 4) as mean_miss, any_value(a.pitch_count) as pitch_count from at_bats_v a left join graded g on a.game_pk = g.game_pk and a.at_bat_index = g.at_bat_index group by 1, 2",
    ),
    "a30_game_actuals": (lambda t: G.game_actuals(t.pitches, t.at_bats), f"with {_ACTUAL} select * from act"),
    "w4_first_and_last": (
        lambda t: G.first_and_last(t.predictions, ["game_pk", "market"], [F.col("at_bat_index"), F.col("pitch_number")], ["recommendation", "confidence"]),
        "select game_pk, market, arg_min(recommendation, at_bat_index * 1000 + pitch_number) as first_recommendation, arg_min(confidence, at_bat_index * 1000 + pitch_number) as first_confidence, arg_max(recommendation, at_bat_index * 1000 + pitch_number) as last_recommendation, arg_max(confidence, at_bat_index * 1000 + pitch_number) as last_confidence, count(*) as n_rows from predictions_v group by 1, 2",
    ),
    "w14_current_position": (
        lambda t: t.pitches.groupBy("game_pk").agg(F.max(F.struct("at_bat_index", "pitch_number")).alias("p")).select("game_pk", "p.*"),
        "select game_pk, max({'a': at_bat_index, 'p': pitch_number}).a as at_bat_index, max({'a': at_bat_index, 'p': pitch_number}).p as pitch_number from pitches_v group by 1",
    ),
    "v13_game_accuracy": (
        lambda t: G.summary(_settled(t).where("confidence >= 0.6"), ["game_pk"]).select("game_pk", "n", "wins", "losses", "win_rate"),
        f"with {_GRADED} select game_pk, count(*) as n, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, round((count(*) filter (where result = 'win')) / nullif(count(*) filter (where result in ('win','loss')), 0), 3) as win_rate from graded where confidence >= 0.6 group by 1",
    ),
    "v14_accuracy_by_count": (
        lambda t: G.accuracy_by_count(_settled(t), t.pitches),
        f"with {_GRADED}, x as (select concat_ws('-', p.balls, p.strikes) as count_state, result from graded g join pitches_v p on p.game_pk = g.game_pk and p.at_bat_index = g.at_bat_index and p.pitch_number - 1 = g.pitch_number where result in ('win','loss')) select count_state, count(*) as graded, count(*) filter (where result = 'win') as \"right\", round((count(*) filter (where result = 'win')) / count(*), 4) as accuracy from x group by 1 having count(*) >= 6 order by graded desc, count_state limit 8",
    ),
    "v17_daily_delta": (
        lambda t: G.daily_delta(G.accuracy_series(_rollup(t), 6)),
        f"with {_GRADED}, s as (select created_date as day, market, round((count(*) filter (where result = 'win')) / nullif(count(*) filter (where result in ('win','loss')), 0), 4) as accuracy from graded group by 1, 2), d as (select *, round(accuracy - lag(accuracy) over (partition by market order by day), 4) as delta, row_number() over (partition by market order by day desc) as k from s where accuracy is not null) select market, day, accuracy, delta from d where k <= 14",
    ),
    "v18_call_pairs": (
        lambda t: G.call_pairs(t.predictions),
        "select game_pk, at_bat_index, pitch_number, max(recommendation) filter (where market = 'pitch_result') as class_call, max(confidence) filter (where market = 'pitch_result') as class_confidence, max(recommendation) filter (where market = 'pitch_speed_ou') as speed_call, max(line) filter (where market = 'pitch_speed_ou') as speed_line from predictions_v group by 1, 2, 3",
    ),
    "v19_most_confident_call": (
        lambda t: t.predictions.groupBy("game_pk").agg(F.max_by(F.struct("id", "market", "recommendation", "confidence"), F.struct("confidence", -F.col("id"))).alias("x")).select("game_pk", "x.*"),
        "select game_pk, id, market, recommendation, confidence from predictions_v qualify row_number() over (partition by game_pk order by confidence desc, id) = 1",
    ),
}
