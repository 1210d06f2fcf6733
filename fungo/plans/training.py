"""Queries over rolling form and training cells, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import features as X
from fungo.plans.display import HARD


def _spine_sql(table: str, measures: dict[str, str]) -> str:
    """Running totals of each pitcher by day. What a window holds is the total before its day less the total before its first day."""
    daily = ", ".join(f"cast(round(avg({v}), 9) as decimal(18, 9)) * cast(count(*) as decimal(12, 0)) as {k}, count({v}) as {k}_seen" for k, v in measures.items())
    names = ["n", *measures, *(f"{k}_seen" for k in measures)]
    running = ", ".join(f"sum({k}) over (partition by who order by day) as {k}_to" for k in names)
    lengths = {w: d for w, d in X.WINDOWS.items() if d is not None}
    starts = " ".join(f"asof left join upto {w}_start on {w}_start.who = d.who and d.day - interval {n} day > {w}_start.day" for w, n in lengths.items())
    cols = []
    for w in X.WINDOWS:
        held = {k: f"coalesce(past.{k}_to, 0)" + (f" - coalesce({w}_start.{k}_to, 0)" if w in lengths else "") for k in names}
        cols += [f"{held['n']} as {w}_n"] + [f"case when {held[f'{k}_seen']} > 0 then cast({held[k]} as double) / ({held['n']}) end as {w}_{k}" for k in measures]
    return f"""with days as (select pitcher_id as who, game_date as day, count(*) as n, {daily} from {table} group by all), upto as (select who, day, {running} from days)
 select d.who as pitcher_id, d.day as game_date, {', '.join(cols)} from days d asof left join upto past on past.who = d.who and d.day > past.day {starts}"""


_PITCH = _spine_sql("pitches_v", {"zone_rate": "case when zone between 1 and 9 then 1.0 else 0.0 end", "velo": "start_speed"})
_PA = _spine_sql("at_bats_v", {"k_rate": "case when result = 'strikeout' then 1.0 else 0.0 end"})


def _spine(df):
    return df.withColumns({f"{w}_n": F.col(f"{w}_n").cast("long") for w in X.WINDOWS})


def _cells_sql(table: str, spine: str, keys: str, feature: str, base: float, step: float, bucket: str, extra: str = "", where: str = "") -> str:
    buckets = ", ".join(f"cast(floor(round(coalesce({w}_{feature} - {base}, 0) / {step}, 9)) as int) as {w}_{bucket}" for w in X.WINDOWS)
    return f"select cast(year(p.game_date) as int) as season, {keys}, {buckets}, {extra} count(*) as n from {table} p join ({spine}) f on f.pitcher_id = p.pitcher_id and f.game_date = p.game_date where f.career_n > 0 {where} group by all"


def _steps(x: str, middle: float, step: float) -> str:
    """Whole steps from the middle, two at most to either side; none where the figure is unknown."""
    q = f"round(({x} - {middle}) / {step})"
    return f"cast(case when {q} > 2 then 2 when {q} < -2 then -2 when {q} is null then 0 else {q} end as int)"


def _with_count_before(table: str) -> str:
    one_back = "over (partition by game_pk, at_bat_index order by pitch_number rows between 1 preceding and 1 preceding)"
    return f"select *, coalesce(max(balls) {one_back}, 0) as had_balls, coalesce(max(strikes) {one_back}, 0) as had_strikes from {table}"


_OFFERED = "description = 'swinging_strike' or description = 'foul' or result_category = 'in_play'"
_LEGAL = "between 0 and 3 and {} between 0 and 2"
#: Counts inside a plate appearance, its start as 0-0.
_COUNTS_OF_PA = """unnest(list_concat([{'b': 0, 's': 0, 'left': a.pitch_count}], coalesce((select list({'b': cast(p.balls as int), 's': cast(p.strikes as int), 'left': a.pitch_count - p.pitch_number}) from pitches_v p
 where p.game_pk = a.game_pk and p.at_bat_index = a.at_bat_index and p.pitch_number < a.pitch_count and p.balls between 0 and 3 and p.strikes between 0 and 2), [])))"""

PLANS = {
    "w1_form_spine": (lambda t: _spine(X.pitch_spine(t.pitches)), _PITCH),
    "w2_form_spine_pa": (lambda t: _spine(X.at_bat_spine(t.at_bats)), _PA),
    "w3_count_before_pitch": (
        lambda t: X.count_before_pitch(t.pitches).select("game_pk", "at_bat_index", "pitch_number", "pre_balls", "pre_strikes"),
        f"select game_pk, at_bat_index, pitch_number, had_balls as pre_balls, had_strikes as pre_strikes from ({_with_count_before('pitches_v')})",
    ),
    "m1_pitch_result_cells": (
        lambda t: X.pitch_result_cells(t.pitches),
        _cells_sql("pitches_v", _PITCH, "balls, strikes, case when is_in_play then 'in_play' when is_ball then 'ball' else 'strike_foul' end as outcome", "zone_rate", X.ZONE_BASE, X.ZONE_STEP, "zone_bucket"),
    ),
    "m2_pa_result_cells": (lambda t: X.at_bat_result_cells(t.at_bats), _cells_sql("at_bats_v", _PA, "0 as balls, 0 as strikes, case when result in ('strikeout','walk','hit','out') then result else 'out' end as outcome", "k_rate", X.STRIKEOUT_BASE, X.STRIKEOUT_STEP, "zone_bucket")),
    "m3_pitch_speed_cells": (
        lambda t: X.pitch_speed_cells(t.pitches),
        _cells_sql("pitches_v", _PITCH, "balls, strikes, least(pitch_number, 10) as pitch_of_pa", "velo", X.SPEED_BASE, X.SPEED_STEP, "velo_bucket", "round(avg(start_speed), 6) as mean_speed, round(coalesce(var_pop(start_speed), 0.0), 6) as var_speed,", "and start_speed is not null"),
    ),
    "m4_remaining_cells": (
        lambda t: X.remaining_pitch_cells(t.pitches, t.at_bats),
        "select cast(year(p.game_date) as int) as season, balls, strikes, least(a.pitch_count - p.pitch_number + 1, 12) as remaining, count(*) as n from at_bats_v a join pitches_v p on p.game_pk = a.game_pk and p.at_bat_index = a.at_bat_index where pitch_count between 1 and 30 and pitch_number <= pitch_count and balls between 0 and 3 and strikes between 0 and 2 group by all",
    ),
    "m5_moneyline_cells": (lambda t: X.moneyline_cells(t.games), "select season, 0 as balls, 0 as strikes, case when home_score > away_score then 1 else 0 end as home_win, count(*) as n from games_v where home_score <> away_score group by all"),
    "a32_clamped_pitch_cells": (
        lambda t: X.clamped_pitch_result_cells(t.pitches),
        f"""
with known as (select *, count(zone) over p as p_seen, avg(case when zone is null then null when zone between 1 and 9 then 1.0 else 0.0 end) over p as p_zone, count(zone) over b as b_seen,
  sum(case when zone >= 10 and ({_OFFERED}) then 1 else 0 end) over b as b_chased, sum(case when zone >= 10 then 1 else 0 end) over b as b_off
  from ({_with_count_before('pitches_v')}) window p as (partition by pitcher_id), b as (partition by batter_id))
select had_balls as balls, had_strikes as strikes, {_steps('case when p_seen >= 100 then p_zone end', 0.48, 0.03)} as zone_bucket, {_steps('case when b_seen >= 100 then b_chased / nullif(b_off, 0) end', 0.28, 0.04)} as chase_bucket, result_category as outcome, count(*) as n
from known where had_balls {_LEGAL.format('had_strikes')} group by all""",
    ),
    "a32_clamped_pa_cells": (
        lambda t: X.clamped_at_bat_cells(t.pitches, t.at_bats),
        f"""
with known as (select *, count(*) over p as p_seen, avg(cast(result = 'strikeout' as int)) over p as p_k, count(*) over b as b_seen, avg(cast(result = 'strikeout' as int)) over b as b_k from at_bats_v
  window p as (partition by pitcher_id), b as (partition by batter_id)),
 states as (select a.*, {_COUNTS_OF_PA} as state from known a)
select state.b as balls, state.s as strikes, {_steps('case when p_seen >= 50 then p_k end', 0.221, 0.035)} as pk_bucket, {_steps('case when b_seen >= 50 then b_k end', 0.221, 0.035)} as bk_bucket, cast(coalesce(pitch_hand = bat_side, false) as int) as platoon_same, result as outcome, count(*) as n
from states group by all""",
    ),
    "a32_clamped_speed_cells": (
        lambda t: X.clamped_speed_cells(t.pitches),
        f"""
with fast as (select *, case when {HARD} then start_speed end as hard from ({_with_count_before('(select * from pitches_v where start_speed is not null)')})),
 known as (select *, count(hard) over p as hard_seen, avg(hard) over p as hard_mean from fast window p as (partition by pitcher_id))
select round(hard_mean) as velo_bucket, had_balls as balls, had_strikes as strikes, case when pitch_number > 8 then 8 else pitch_number end as pitch_of_pa, count(*) as n, round(avg(start_speed), 6) as mean_speed, round(var_samp(start_speed), 6) as var_speed
from known where hard_seen >= 50 and had_balls {_LEGAL.format('had_strikes')} group by 1, 2, 3, 4 having n >= 20""",
    ),
    "a32_clamped_remaining_cells": (
        lambda t: X.clamped_remaining_cells(t.pitches, t.at_bats),
        f"""
with states as (select {_COUNTS_OF_PA} as state from at_bats_v a)
select state.b as balls, state.s as strikes, case when state."left" > 12 then 12 else state."left" end as remaining, count(*) as n from states where state."left" > 0 group by all""",
    ),
}
