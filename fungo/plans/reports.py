"""Queries of the board, the graded feed, coverage and health, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import grading as G
from fungo.operators import reports as V
from fungo.plans.grading import _GRADED

DAY, FIRST, LAST, NOW = "1998-07-15", "1995-01-01", "1996-12-31", "1999-01-01 06:30:00"

#: Calls with a predicted speed and an edge, drawn from the calls themselves.
_PREDICTED = "case when market = 'pitch_speed_ou' then round(85.0::double + id % 130 / 10.0::double, 1) end"
_EDGE = "round(confidence - 0.5 + game_pk % 13 / 100.0::double, 4)"
_NAMES = "select pitcher_id as player_id, 'Player ' || pitcher_id as full_name from pitches_v group by pitcher_id union all select batter_id, 'Player ' || batter_id from pitches_v where batter_id % 4 <> 0 group by batter_id"
#: Job runs and a registry, drawn from the events and calls.
_RUNS = "select event_type as job, ts as finished_at, value > 20 as ok from events"
_REGISTRY = "select market, max(model_version) as version, true as is_active from predictions_v group by market union all select market, min(model_version), false from predictions_v group by market"


def _calls(t):
    settled = G.settle_pitch_calls(t.predictions, t.pitches, t.games)
    speed = F.when(F.col("market") == "pitch_speed_ou", F.round(85.0 + F.col("id") % 130 / 10.0, 1))
    return settled.withColumns({"predicted_value": speed, "edge": F.round(F.col("confidence") - 0.5 + F.col("game_pk") % 13 / 100.0, 4)})


def _feed(t):
    return V.graded_feed(_calls(t), t.games, t.at_bats, t.pitches, t.sql(_NAMES))


_CALLED = f"{_GRADED}, calls as (select *, {_PREDICTED} as predicted_value, {_EDGE} as edge from graded)"
_FEED_SQL = f"""{_CALLED}, names as (select player_id, min(full_name) as full_name from ({_NAMES}) group by 1)
select c.id, g.game_date as official_date, c.game_pk, g.away_team_id || ' @ ' || g.home_team_id as game_label, c.at_bat_index, c.pitch_number, c.market, c.recommendation, c.predicted_value, c.line, c.confidence, c.result, c.actual_value, c.actual_label,
 round(c.predicted_value - c.actual_value, 2) as miss, c.profit_units, b.pitcher_id, b.batter_id, case when p.game_pk is not null then p.inning when c.pitch_number = 0 then n.inning end as inning,
 case case when p.game_pk is not null then p.top_inning when c.pitch_number = 0 then n.top_inning end when true then 'top' when false then 'bottom' end as half,
 case when p.game_pk is not null then p.balls || '-' || p.strikes when c.pitch_number = 0 and n.game_pk is not null then '0-0' end as count_text, case when p.game_pk is not null then p.outs when c.pitch_number = 0 then n.outs end as outs,
 n.pitch_type as next_pitch_type, c.backfilled, pn.full_name as pitcher_name, bn.full_name as batter_name
from calls c join games_v g on g.game_pk = c.game_pk left join at_bats_v b on b.game_pk = c.game_pk and b.at_bat_index = c.at_bat_index
 left join pitches_v p on p.game_pk = c.game_pk and p.at_bat_index = c.at_bat_index and p.pitch_number = c.pitch_number left join pitches_v n on n.game_pk = c.game_pk and n.at_bat_index = c.at_bat_index and n.pitch_number = c.pitch_number + 1
 left join names pn on pn.player_id = b.pitcher_id left join names bn on bn.player_id = b.batter_id"""

PLANS = {
    "v6_graded_feed": (_feed, f"with {_FEED_SQL}"),
    "v6_feed_summary": (
        lambda t: V.feed_summary(_feed(t)),
        f"with {_CALLED} select game_date as official_date, count(*) as n, count(result) as graded, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses, count(*) filter (where result = 'push') as pushes, count(*) filter (where backfilled) as backfilled, count(distinct c.game_pk) as games from calls c join games_v g on g.game_pk = c.game_pk group by 1",
    ),
    "v9_coverage_report": (
        lambda t: V.coverage_report(t.games, t.predictions, t.pitches, 2, (F.col("at_bat_index") == 0) & (F.col("pitch_number") == 0), F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")),
        f"""with seen as (select game_pk, count(distinct market) as m, count(distinct case when at_bat_index = 0 and pitch_number = 0 then market end) as e from predictions_v group by 1),
 window_ as (select * from games_v where game_date between date '{FIRST}' and date '{LAST}'),
 per_game as (select g.game_date, coalesce(m, 0) as m, coalesce(e, 0) as e from window_ g left join seen s on s.game_pk = g.game_pk),
 days as (select game_date, count(*) as games, count(*) filter (where m >= 2) as full_cov, count(*) filter (where m = 1) as partial_cov, count(*) filter (where m = 0) as zero_cov, count(*) filter (where e >= 2) as pregame_full, sum(m) as markets from per_game group by 1),
 stamped as (select game_pk, at_bat_index, pitch_number, max(cast(market = 'pitch_speed_ou' as int)) as v, max(cast(market = 'pitch_result' as int)) as r from predictions_v group by 1, 2, 3),
 thrown as (select g.game_date, count(*) as pitches_thrown, coalesce(sum(v), 0) as velo_called, coalesce(sum(r), 0) as result_called, count(*) filter (where v = 1 and r = 1) as both_called, count(*) filter (where v is null) as uncalled
  from pitches_v p join window_ g on g.game_pk = p.game_pk left join stamped s on s.game_pk = p.game_pk and s.at_bat_index = p.at_bat_index and s.pitch_number = p.pitch_number - 1 group by 1),
 joined as (select d.*, t.* exclude (game_date) from days d left join thrown t on t.game_date = d.game_date)
select game_date as official_date, {', '.join(f'cast(coalesce(sum({c}), 0) as bigint) as {c}' for c in ('games', 'full_cov', 'partial_cov', 'zero_cov', 'pregame_full', 'pitches_thrown', 'velo_called', 'result_called', 'both_called', 'uncalled'))},
 round(sum(markets) / sum(games), 3) as avg_markets, round(sum(pregame_full) / sum(games), 3) as pregame_full_rate, round(sum(both_called) / nullif(sum(pitches_thrown), 0), 3) as both_rate from joined group by grouping sets ((game_date), ())""",
    ),
    "v12_health": (
        lambda t: V.health(t.sql(_RUNS), t.sql(_REGISTRY), {"games": (t.games, "game_date"), "quotes": (t.odds, "fetched_at")}, F.lit(NOW)),
        f"""with runs as ({_RUNS}), done as (select job, count(*) as n, max(finished_at) filter (where ok) as done_at from runs group by 1), pub as (select 'games' as name, count(*) as n, max(game_date)::timestamp as done_at from games_v union all select 'quotes', count(*), max(fetched_at)::timestamp from odds_v)
select 'job' as section, job as name, strftime(done_at, '%Y-%m-%d %H:%M:%S') as detail, n, cast(floor(epoch(timestamp '{NOW}')) - floor(epoch(done_at)) as bigint) as age, cast(null as boolean) as stale from done
union all select 'model', market, version, null, null, null from ({_REGISTRY}) where is_active
union all select 'table', name, strftime(done_at, '%Y-%m-%d %H:%M:%S'), n, cast(round(date_diff('second', done_at, timestamp '{NOW}') / 3600.0) as bigint), round(date_diff('second', done_at, timestamp '{NOW}') / 3600.0) > {V.STALE_HOURS} from pub""",
    ),
    "v4_board": (
        lambda t: V.board(t.games, _calls(t), F.lit(DAY).cast("date")),
        f"""with {_CALLED}, newest as (select * from calls qualify row_number() over (partition by game_pk, market order by id desc) = 1),
 best as (select game_pk, count(*) as markets, arg_max(market, (edge, market)) as best_market, max(edge) as best_edge from newest group by 1),
 slate as (select case when status = 'Final' then 'final' when status = 'In Progress' then 'live' else 'upcoming' end as section, g.game_pk, coalesce(markets, 0) as markets, best_market, best_edge from games_v g left join best b on b.game_pk = g.game_pk where game_date = date '{DAY}'),
 over_ as (select game_date from games_v where game_date between date '{DAY}' - 11 and date '{DAY}' - 1 group by 1 having bool_and(status = 'Final') order by 1 desc limit 1)
select 'recap' as section, 1 as place, cast(null as bigint) as game_pk, 0 as markets, cast(null as varchar) as best_market, cast(null as double) as best_edge, count(*) filter (where result = 'win') as wins, count(*) filter (where result = 'loss') as losses from calls where game_pk in (select game_pk from games_v where game_date in (select game_date from over_))
union all select section, cast(row_number() over (partition by section order by best_edge desc nulls last, game_pk) as int), game_pk, markets, best_market, best_edge, null, null from slate""",
    ),
}
