"""Queries over the display aggregates, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators import aggregates as A
from fungo.sources.views import Tables

SEASON, DIGITS = 1995, 8
AS_OF = "1998-07-15"

#: Sums a player and day, and averages from them. A name is the sum of a 0/1 mark of each pitch.
_AWAY = "zone > 9"
_MARKS = {
    "inside": "zone between 1 and 9",
    "outside": _AWAY,
    "missed": "description = 'swinging_strike'",
    "touched": "description = 'foul' or result_category = 'in_play'",
    "swings": "description = 'swinging_strike' or description = 'foul' or result_category = 'in_play'",
    "chases": _AWAY + " and (description = 'swinging_strike' or description = 'foul' or result_category = 'in_play')",
}
HARD = f"pitch_type in {P.FASTBALLS}"
_FLOOR = "(select cast(min(year(game_date)) as int) from pitches_v)"


def _pitch_days(player: str) -> str:
    marks = ", ".join(f"sum(case when {test} then 1 else 0 end) as {name}" for name, test in _MARKS.items())
    kinds = (("hard", HARD), ("soft", f"not {HARD}"))
    speeds = ", ".join(f"sum(cast(case when {test} then start_speed end as decimal(18,6))) as {name}_sum, count(case when {test} then start_speed end) as {name}_n" for name, test in kinds)
    return f"select {player} as who, game_date as day, count(*) as thrown, {marks}, {speeds} from pitches_v group by {player}, game_date"


def _plate_days(player: str) -> str:
    return f"select {player} as who, game_date as day, count(*) as pa, sum(cast(result = 'strikeout' as int)) as ks, sum(cast(result = 'walk' as int)) as walks from at_bats_v group by {player}, game_date"


def _spans(days: str, newest: str) -> str:
    """Rows of a day table once for each scope that covers the day."""
    last = f"(select max(game_date) from {newest})"
    return f"(select 'career' as scope, * from {days} union all select 'season', * from {days} where date_part('year', day) = date_part('year', {last}) union all select 'd30', * from {days} where date_diff('day', day, {last}) < {A.RECENT_DAYS})"


def _totals(days: str, columns: str) -> str:
    return ", ".join(f"sum({c}) as {c}" for c in columns.split()) + f" from {days}"


_SUMS = "thrown inside outside missed touched swings chases hard_sum hard_n soft_sum soft_n"
_DISCIPLINE = {"zone_rate": "inside / nullif(thrown, 0)", "whiff_rate": "missed / nullif(swings, 0)", "chase_rate": "chases / nullif(outside, 0)", "contact_rate": "touched / nullif(swings, 0)"}
_OUTCOMES = {"k_rate": "ks / pa", "bb_rate": "walks / pa"}
_SPEEDS = {"avg_fastball_velo": "hard_sum / nullif(hard_n, 0)", "avg_offspeed_velo": "soft_sum / nullif(soft_n, 0)"}


def _rounded(rates: dict[str, str], digits: int = 4) -> str:
    return ", ".join(f"round({x}, {digits}) as {name}" for name, x in rates.items())


def _profiles(player: str) -> str:
    return f"""
with pitch_days as ({_pitch_days(player)}), plate_days as ({_plate_days(player)}),
 thrown_by as (select scope, who, {_totals(_spans('pitch_days', 'pitches_v'), _SUMS)} group by scope, who),
 plate_by as (select scope, who, {_totals(_spans('plate_days', 'at_bats_v'), 'pa ks walks')} group by scope, who)
select t.who as player_id, t.scope, {_FLOOR} as season_floor, cast(thrown as bigint) as pitches, cast(coalesce(pa, 0) as bigint) as pa, {_rounded(_DISCIPLINE)}, {_rounded(_OUTCOMES)},
 {_rounded(_SPEEDS, DIGITS)}
from thrown_by t left join plate_by b on b.scope = t.scope and b.who = t.who where thrown >= {A.MIN_PITCHES} and t.who is not null"""


def _rolling(player: str) -> str:
    recent = f"where date_diff('day', day, date '{AS_OF}') <= {A.RECENT_DAYS} group by who"
    return f"""
with thrown_by as (select who, {_totals(f'({_pitch_days(player)})', _SUMS)} {recent}), plate_by as (select who, {_totals(f'({_plate_days(player)})', 'pa ks walks')} {recent})
select t.who as {player}, cast(thrown as bigint) as sample_pitches, cast(coalesce(pa, 0) as bigint) as sample_abs, {_rounded(_DISCIPLINE)}, {_rounded(_OUTCOMES)}, {_rounded(_SPEEDS, DIGITS)}
from thrown_by t left join plate_by b on b.who = t.who where thrown >= {A.MIN_PITCHES}"""


def running(days: str, columns: str, key: str = "who") -> str:
    """A day table with running sums up to and with each day."""
    return f"select {key}, day, {', '.join(f'sum({c}) over (partition by {key} order by day) as {c}' for c in columns.split())} from ({days})"


def before(asked: str, table: str, columns: str, frames: dict[str, str | None], key: str = "who") -> str:
    """For each (key, day) of ``asked`` the sums of the days before it since each frame's first day (an expression of ``day``; None: ever), by as-of joins with running sums."""
    since = {name: first for name, first in frames.items() if first is not None}
    cuts = "".join(f", {first} as from_{name}" for name, first in since.items())
    joins = "".join(f" asof left join {table} {name}_ on {name}_.{key} = a.{key} and a.from_{name} > {name}_.day" for name in since)
    less = lambda name, c: f" - coalesce({name}_.{c}, 0)" if name in since else ""
    sums = ", ".join(f"coalesce(now_.{c}, 0){less(name, c)} as {name}_{c}" for name in frames for c in columns.split())
    return f"select a.{key}, a.day, {sums} from (select {key}, day{cuts} from {asked}) a asof left join {table} now_ on now_.{key} = a.{key} and a.day > now_.day{joins}"


def rolling_before(player: str, asked: str, p: str) -> str:
    """Common table expressions for the rolling figures before each asked (who, day): <p>_form."""
    joined = f"select coalesce(t.who, b.who) as who, coalesce(t.day, b.day) as day, {', '.join(f'coalesce({c}, 0) as {c}' for c in f'{_SUMS} pa ks walks'.split())} from ({_pitch_days(player)}) t full join ({_plate_days(player)}) b on b.who = t.who and b.day = t.day"
    names = f"{_SUMS} pa ks walks"
    plain = ", ".join(f"r_{c} as {c}" for c in names.split())
    return f"""
{p}_run as ({running(joined, names)}), {p}_ask as ({asked}),
{p}_sums as ({before(f'{p}_ask', f'{p}_run', names, {'r': f'day - {A.RECENT_DAYS}'})}),
{p}_form as (select who, day, cast(thrown as bigint) as sample_pitches, cast(pa as bigint) as sample_abs, {_rounded(_DISCIPLINE)}, {_rounded({k: x.replace('/ pa', '/ nullif(pa, 0)') for k, x in _OUTCOMES.items()})}, {_rounded(_SPEEDS, DIGITS)} from (select who, day, {plain} from {p}_sums) where thrown >= {A.MIN_PITCHES})"""


_SIDES = f"""
with s as (select home_team_id as team_id, home_score as rs, away_score as ra from games_v where season = {SEASON} and status like 'Final%' and game_type = 'R'
 union all select away_team_id, away_score, home_score from games_v where season = {SEASON} and status like 'Final%' and game_type = 'R')"""

_CATEGORIES = {"strike_foul": "strike_foul_rate", "ball": "ball_rate", "in_play": "in_play_rate"}
_RESULTS = {"strikeout": "so_rate", "walk": "bb_rate", "hit": "hit_rate", "out": "out_rate"}


def _category_sql(table: str, key: str, column: str, values: dict[str, str], mean: str, mean_name: str, floor: int) -> str:
    rates = ", ".join(f"round(avg(case when {column} = '{v}' then 1.0 else 0.0 end), 4) as {n}" for v, n in values.items())
    group = f"group by {key} having count(*) >= {floor}" if key else ""
    return f"select {key + ',' if key else ''} count(*) as n, round(avg({mean}), {DIGITS}) as {mean_name}, {rates} from {table} {group}"


def _league(t: Tables):
    pitch = A.category_rates(t.pitches, [], "result_category", _CATEGORIES, "start_speed", "avg_speed", digits=DIGITS).withColumnRenamed("n", "pitch_sample")
    pa = A.category_rates(t.at_bats, [], "result", _RESULTS, "pitch_count", "avg_pitches_pa", digits=DIGITS).withColumnRenamed("n", "ab_sample")
    return pitch.crossJoin(pa)  # one row each


PLANS = {
    "a1_pitcher_profiles": (lambda t: A.floored(A.player_profiles(t.pitches, t.at_bats, "pitcher_id", 0, speed_digits=DIGITS), t.pitches), _profiles("pitcher_id")),
    "a2_batter_profiles": (lambda t: A.floored(A.player_profiles(t.pitches, t.at_bats, "batter_id", 0, speed_digits=DIGITS), t.pitches), _profiles("batter_id")),
    "a3_situational_splits": (
        lambda t: A.floored(A.situational_splits(t.pitches, t.at_bats, 0, speed_digits=DIGITS), t.pitches),
        f"""
with sides as (select * from (select unnest([{{'role': 'pitcher', 'who': pitcher_id, 'other_hand': bat_side}}, {{'role': 'batter', 'who': batter_id, 'other_hand': pitch_hand}}], recursive := true), men_on_base, result from at_bats_v)),
 counted as (select role, who, men_on_base, other_hand, count(*) as pa, sum(cast(result = 'strikeout' as int)) as ks, sum(cast(result = 'walk' as int)) as walks, sum(cast(result = 'hit' as int)) as hits from sides group by all),
 speeds as (select pitcher_id, men_on_base, bat_side, sum(start_speed) / nullif(count(start_speed), 0) as speed from pitches_v group by all)
select role, who as player_id, c.men_on_base, other_hand as opp_hand, pa, {_rounded(_OUTCOMES | {'hit_rate': 'hits / pa'})}, {_FLOOR} as season_floor, round(case when role = 'pitcher' then speed end, {DIGITS}) as avg_velo
from counted c left join speeds s on s.pitcher_id = who and s.men_on_base = c.men_on_base and s.bat_side = other_hand""",
    ),
    "a4_pitcher_fatigue": (
        lambda t: A.floored(A.fatigue_profile(t.pitches, 0, speed_digits=DIGITS), t.pitches),
        f"""
with steps as (select pitcher_id, case when pitch_of_game >= 100 then 4 else cast(floor(pitch_of_game / 25) as int) end as step, count(*) as n, sum(start_speed) / nullif(count(start_speed), 0) as speed,
  sum(case when {_MARKS['missed']} then 1 else 0 end) as missed, sum(case when {_MARKS['swings']} then 1 else 0 end) as swings from pitches_v group by 1, 2)
select pitcher_id, step as pitch_bucket, {_FLOOR} as season_floor, n, round(speed, {DIGITS}) as mean_velo, round(speed - max(case when step = 0 then speed end) over (partition by pitcher_id), {DIGITS + 1}) as velo_delta_vs_bucket0, round(missed / nullif(swings, 0), 4) as whiff_rate from steps""",
    ),
    "a5_batter_power": (
        lambda t: A.floored(A.power_profile(t.pitches, t.at_bats, 0, digits=DIGITS), t.pitches),
        f"""
with bases as (select batter_id as who, game_date as day, case result_detail when 'single' then 1 when 'double' then 2 when 'triple' then 3 when 'home_run' then 4 else 0 end as reached,
  result_detail in ('walk', 'intent_walk', 'hit_by_pitch', 'sac_fly', 'sac_bunt', 'catcher_interf') as free from at_bats_v),
 plate_days as (select who, day, count(*) as pa, sum(cast(reached = 4 as int)) as hr, sum(cast(reached > 1 as int)) as xbh, sum(reached) as total, sum(greatest(reached - 1, 0)) as extra, sum(case when not free then 1 else 0 end) as charged from bases group by all),
 hit_days as (select batter_id as who, game_date as day, count(launch_speed) as tracked, sum(launch_speed) as speed_sum, sum(launch_angle) as angle_sum, count(launch_angle) as angles,
  sum(case when launch_speed >= 98 and launch_angle >= 26 - (launch_speed - 98) and launch_angle <= 30 + (launch_speed - 98) then 1 else 0 end) as squared from pitches_v where result_category = 'in_play' group by all),
 plate_by as (select scope, who, {_totals(_spans('plate_days', 'at_bats_v'), 'pa hr xbh total extra charged')} group by scope, who),
 hit_by as (select scope, who, {_totals(_spans('hit_days', 'pitches_v'), 'tracked speed_sum angle_sum angles squared')} group by scope, who)
select p.who as batter_id, p.scope, {_FLOOR} as season_floor, cast(pa as bigint) as pa, cast(hr as bigint) as hr, cast(xbh as bigint) as xbh, cast(total as bigint) as total_bases, round(extra / nullif(charged, 0), 4) as iso,
 round(squared / nullif(tracked, 0), 4) as barrel_rate, round(speed_sum / nullif(tracked, 0), {DIGITS}) as avg_launch_speed, round(angle_sum / nullif(angles, 0), {DIGITS}) as avg_launch_angle
from plate_by p left join hit_by h on h.scope = p.scope and h.who = p.who where pa >= {A.MIN_PA}""",
    ),
    "a6_game_context": (lambda t: A.game_context(t.games.unionByName(t.games.where("game_pk % 7 = 0"))), "select * from games_v"),
    "a7_matchup_history": (
        lambda t: A.floored(A.matchup_history(t.at_bats, 0), t.pitches),
        f"""
with met as (select *, count(*) over pair as pa_count, row_number() over (pair order by game_date desc, game_pk desc, at_bat_index desc) as back from at_bats_v window pair as (partition by pitcher_id, batter_id))
select pitcher_id, batter_id, {_FLOOR} as season_floor, any_value(pa_count) as pa_count, {', '.join(f"cast(sum(cast({test} as int)) as bigint) as {name}" for name, test in (('so_count', "result = 'strikeout'"), ('bb_count', "result = 'walk'"), ('h_count', "result = 'hit'"), ('hr_count', "coalesce(result_detail = 'home_run', false)")))},
 any_value(case when back = 1 then bat_side end) as bat_side, any_value(case when back = 1 then pitch_hand end) as pitch_hand, any_value(case when back = 1 then game_date end) as last_faced from met where pa_count >= {A.MIN_MEETINGS} group by pitcher_id, batter_id""",
    ),
    "a9_pitcher_rolling_stats": (lambda t: A.rolling_stats(t.pitches, t.at_bats, "pitcher_id", F.lit(AS_OF).cast("date"), speed_digits=DIGITS), _rolling("pitcher_id")),
    "a10_batter_rolling_stats": (lambda t: A.rolling_stats(t.pitches, t.at_bats, "batter_id", F.lit(AS_OF).cast("date"), speed_digits=DIGITS), _rolling("batter_id")),
    "a11_pitcher_stats": (
        lambda t: A.category_rates(t.pitches, ["pitcher_id"], "result_category", _CATEGORIES, "start_speed", "avg_speed", 10, DIGITS).withColumns({c: F.round(c, 4) for c in _CATEGORIES.values()}),
        _category_sql("pitches_v", "pitcher_id", "result_category", _CATEGORIES, "start_speed", "avg_speed", 10),
    ),
    "a11_capped_pitcher_sample": (
        lambda t: A.capped_sample(t.pitches, "pitcher_id", [F.desc("game_pk"), F.desc("at_bat_index"), F.desc("pitch_number")], 200).groupBy("pitcher_id").agg(F.count("*").alias("n"), F.min("game_pk").alias("oldest_game")),
        "select pitcher_id, count(*) as n, min(game_pk) as oldest_game from (select *, row_number() over (partition by pitcher_id order by game_pk desc, at_bat_index desc, pitch_number desc) as k from pitches_v) where k <= 200 group by 1",
    ),
    "a12_pitcher_ab_stats": (
        lambda t: A.category_rates(t.at_bats, ["pitcher_id"], "result", _RESULTS, "pitch_count", "avg_pitches", 5, DIGITS).withColumns({c: F.round(c, 4) for c in _RESULTS.values()}),
        _category_sql("at_bats_v", "pitcher_id", "result", _RESULTS, "pitch_count", "avg_pitches", 5),
    ),
    "a13_league_averages": (
        lambda t: _league(t).withColumns({c: F.round(c, 4) for c in (*_CATEGORIES.values(), *_RESULTS.values())}),
        f"""
with p as ({_category_sql('pitches_v', '', 'result_category', _CATEGORIES, 'start_speed', 'avg_speed', 0)}), a as ({_category_sql('at_bats_v', '', 'result', _RESULTS, 'pitch_count', 'avg_pitches_pa', 0)})
select p.n as pitch_sample, p.* exclude (n), a.n as ab_sample, a.* exclude (n) from p cross join a""",
    ),
    "a14_team_run_rates": (lambda t: A.team_run_rates(t.games, SEASON), _SIDES + " select team_id, count(*) as games, round(avg(rs), 3) as rs_pg, round(avg(ra), 3) as ra_pg, round(avg(case when rs > ra then 1.0 else 0.0 end), 4) as win_pct from s group by 1"),
    "a15_park_factors": (
        lambda t: A.park_factors(t.games),
        """
with s as (select venue_id, home_score + away_score as runs from games_v), l as (select avg(runs) as m from s), v as (select venue_id, count(*) as games, avg(runs) as r from s group by 1)
select venue_id, games, round(r, 3) as runs_pg, round(1 + (r / nullif(m, 0) - 1) * (games / (games + 200)), 4) as factor from v cross join l""",
    ),
    "a16_season_win_share": (lambda t: A.season_win_share(t.games, SEASON), _SIDES + " select team_id, count(*) as games, case when count(*) >= 10 then round(avg(case when rs > ra then 1.0 else 0.0 end), 4) end as win_pct from s group by 1"),
    "a17_home_advantage": (lambda t: A.home_advantage(t.games), "select count(*) as games, round(avg(case when home_score > away_score then 1.0 else 0.0 end), 6) as home_win_rate from games_v where status like 'Final%' and home_score <> away_score"),
    "w5_dedupe_first": (
        lambda t: A.first_per_key(t.base("events").select("event_id", "user_id", "event_type", "ts"), ["user_id", "event_type"], [F.col("ts"), F.col("event_id")]),
        "select event_id, user_id, event_type, ts from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) = 1",
    ),
}
