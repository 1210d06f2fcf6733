"""Queries that score with the figures of the day before, and predictors from frequencies, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import aggregates as A
from fungo.operators import asof
from fungo.operators import frequency as Q
from fungo.operators import pricing as R
from fungo.operators import slate as S
from fungo.plans.display import _CATEGORIES, _RESULTS, DIGITS, _category_sql, before, rolling_before, running
from fungo.plans.market import _cdf, blend_sql, shift_sql

_KEY = ["game_pk", "at_bat_index", "pitch_number"]
#: Shares of a pitcher enter the predictors rounded, as the stored figures are.
RATE_DIGITS = 4

#: Quotes of totals and speeds for some games, drawn from the games themselves.
LINES = """
select game_pk, 'game_total' as market, cast(7.5 as double) + game_pk % 4 as line, cast(-110 as int) as over_price, cast(-105 - game_pk % 9 as int) as under_price, 'espn' as source, game_date as fetched_at, game_pk as id from games_v where game_pk % 3 = 0
 union all select game_pk, 'game_total', cast(6.5 as double) + game_pk % 5, cast(100 + game_pk % 30 as int), cast(-120 as int), 'kalshi', game_date, game_pk + 1 from games_v where game_pk % 6 = 0
 union all select game_pk, 'pitch_speed_ou', cast(90.5 as double), cast(-115 as int), cast(-105 as int), 'espn', game_date, game_pk from games_v where game_pk % 4 = 1"""
PRICES = "select id, game_pk, market, outcome, price_american, source, fetched_at from odds_v where game_pk % 5 <> 2"


def _slate(t):
    return S.slate_scores(t.games, t.games, S.starters_of_plays(t.pitches), t.pitches, t.at_bats, t.sql(LINES), t.sql(PRICES), digits=6)


def _over(mean: str, sigma: str, line: str = "line") -> str:
    return f"1 - {_cdf(f'(({line} - {mean}) / {sigma})')}"


def _american(p: str) -> str:
    return f"case when {p} < 0 then -{p} / (100.0 - {p}) when {p} >= 0 then 100.0 / (100 + {p}) end"


def _line_sql(source: str, market: str, mean: str, sigma: str) -> str:
    """A market's rows from (game_pk, mean, sigma) and the quotes: own line where there is none."""
    return f"""select game_pk, official_date, '{market}' as market, mean as predicted_value, round(side, 4) as confidence, case when ov >= 0.5 then 'over' else 'under' end as recommendation, line, cast(price as int) as price,
 round(side - case when book = 'model_fair' then 0.5::double else {_american('price')} end, 4) as edge, book, version as model_version
 from (select *, greatest(ov, 1 - ov) as side, case when book = 'model_fair' then 100 when ov >= 0.5 then over_price else under_price end as price
  from (select *, {_over('mean', 'sigma')} as ov from (select s.game_pk, s.official_date, s.version, s.mean, s.sigma, coalesce(q.line, floor(mean * 2 + 0.5) / 2) as line, q.over_price, q.under_price, coalesce(q.source, 'model_fair') as book
   from (select game_pk, official_date, {mean} as mean, {sigma} as sigma, '{'total_v1' if market == 'game_total' else S.VERSION}' as version from {source}) s left join best q on q.game_pk = s.game_pk and q.market = '{market}')))"""


def _class_sql(market: str, parts: dict[str, str]) -> str:
    total = " + ".join(parts.values())
    most = f"greatest({', '.join(parts)})"
    names = " ".join(f"when {k} = most then '{k}'" for k in parts)
    shares = ", ".join(f"round(avg(({x}) / ({total})), 6) as {k}" for k, x in parts.items())
    return f"select game_pk, official_date, '{market}' as market, most as predicted_value, most as confidence, case {names} end as recommendation, cast(null as double) as line, cast(null as int) as price, cast(null as double) as edge, cast(null as varchar) as book, '{S.VERSION}' as model_version from (select *, {most} as most from (select game_pk, day as official_date, {shares} from sides group by 1, 2))"


def _pitch_parts(balls: str = "0", strikes: str = "0") -> dict[str, str]:
    shift = lambda k: "0" if balls == "0" else shift_sql(k)
    sf, b, ip = (f"greatest(0.0, {R.LEAGUE_PITCH[k]}::double + {shift(k)})" for k in R.LEAGUE_PITCH)
    return {"strike_foul": f"({sf} + case when pz > {R.ZONE_HIGH} then {R.MORE_STRIKES} else 0 end)", "ball": f"({b} + case when pz < {R.ZONE_LOW} then {R.MORE_BALLS} else 0 end)", "in_play": ip}



def _first_scope(column: str) -> str:
    rate = lambda f: f"{f}_pa" if column == "pa" else f"round({f}_{column} / nullif({f}_pa, 0), 4)"
    return "case " + " ".join(f"when {f}_thrown >= {A.MIN_PITCHES} then {rate(f)}" for f in ("season", "d30", "career")) + " end"


def _starter_sql(k: str, w: str, pa: str) -> str:
    effect = f"({R.STARTER_WALKS} * ({blend_sql(w, R.LEAGUE_PA['walk'], pa, R.STARTER_N)} - {R.LEAGUE_PA['walk']}) - {R.STARTER_STRIKEOUTS} * ({blend_sql(k, R.LEAGUE_PA['strikeout'], pa, R.STARTER_N)} - {R.LEAGUE_PA['strikeout']}))"
    low, high = R.STARTER_RANGE
    return f"case when {pa} is null then 1.0::double else least({high}, greatest({low}, 1 + {R.STARTER_SHARE} * {effect})) end"


_STARTERS = """
starters as (select game_pk, max(case when side = 'home' then pid end) as home_pid, max(case when side = 'away' then pid end) as away_pid from (select game_pk, case when top_inning then 'home' else 'away' end as side, arg_min(pitcher_id, at_bat_index) as pid from pitches_v group by 1, 2) group by 1),
slate as (select g.game_pk, g.game_date as day, home_team_id, away_team_id, venue_id, home_pid, away_pid from games_v g left join starters s on s.game_pk = g.game_pk)"""
_ASKED = "select distinct who, day from (select home_pid as who, day from slate union all select away_pid, day from slate) where who is not null"
_SEASON = "make_date(year(day), 1, 1)"
_PARK = "make_date(year(day) - 3, 1, 1)"
_TEAM_SIDES = """select home_team_id as who, game_date as day, 1 as n, home_score as runs, away_score as allowed, cast(home_score > away_score as int) as won from games_v where status like 'Final%' and game_type = 'R'
 union all select away_team_id, game_date, 1, away_score, home_score, cast(away_score > home_score as int) from games_v where status like 'Final%' and game_type = 'R'"""
_TEAM_DAYS = f"select who, day, {', '.join(f'sum({c}) as {c}' for c in ('n', 'runs', 'allowed', 'won'))} from ({_TEAM_SIDES}) group by all"
_PARK_DAYS = "select {key} as who, game_date as day, count(*) as n, sum(home_score + away_score) as runs from games_v group by 1, 2"


def _slate_sql() -> str:
    side = lambda s: f"select game_pk, s.day, pz, pk, pbb, pa, round({blend_sql('pv', R.LEAGUE_SPEED, 'pp', R.SPEED_N)} - {R.BELOW_FASTBALL}, 2) as mu from (select s.game_pk, s.day, f.zone_rate as pz, f.k_rate as pk, f.bb_rate as pbb, f.sample_abs as pa, f.sample_pitches as pp, f.avg_fastball_velo as pv from slate s left join pr_form f on f.who = s.{s}_pid and f.day = s.day) s"
    ab = {"strikeout": blend_sql("pk", R.LEAGUE_PA["strikeout"], "pa", R.PITCHER_N), "walk": blend_sql("pbb", R.LEAGUE_PA["walk"], "pa", R.PITCHER_N), "hit": f"{R.LEAGUE_PA['hit']}::double", "out": f"{R.LEAGUE_PA['out']}::double"}
    part = lambda c: blend_sql(c, R.LEAGUE_RUNS, "n", R.RATE_N)
    held = lambda x, r: f"case when ({x}) is not null then least({r[1]}::double, greatest({r[0]}::double, {x})) end"
    names = "thrown pa ks walks"
    full = rolling_before("pitcher_id", _ASKED, "pr")
    return f"""
with {_STARTERS}, {full},
 pf_sums as ({before('pr_ask', 'pr_run', names, {'season': _SEASON, 'd30': f'day - {A.RECENT_DAYS}', 'career': None})}),
 prof as (select who, day, {_first_scope('pa')} as pa, {_first_scope('ks')} as k, {_first_scope('walks')} as w from pf_sums),
 t_run as ({running(_TEAM_DAYS, 'n runs allowed won')}), t_ask as (select distinct who, day from (select home_team_id as who, day from slate union all select away_team_id, day from slate)),
 team as (select who, day, s_n as n, round(s_runs / nullif(s_n, 0), 3) as rs, round(s_allowed / nullif(s_n, 0), 3) as ra, round(s_won / nullif(s_n, 0), 4) as pct from ({before('t_ask', 't_run', 'n runs allowed won', {'s': _SEASON})})),
 v_run as ({running(_PARK_DAYS.format(key='venue_id'), 'n runs')}), v_ask as (select distinct venue_id as who, day from slate),
 l_run as ({running(_PARK_DAYS.format(key='0'), 'n runs')}), l_ask as (select distinct 0 as who, day from slate),
 park as (select v.who, v.day, round(1 + ((v.f_runs / v.f_n) / nullif(l.f_runs / nullif(l.f_n, 0), 0) - 1) * (v.f_n / (v.f_n + 200)), 4) as factor
  from ({before('v_ask', 'v_run', 'n runs', {'f': _PARK})}) v join ({before('l_ask', 'l_run', 'n runs', {'f': _PARK})}) l on l.day = v.day where v.f_n > 0),
 best as (select * from ({LINES}) where line is not null qualify row_number() over (partition by game_pk, market order by fetched_at desc, id desc) = 1),
 money as (select * from ({PRICES}) qualify row_number() over (partition by game_pk, outcome order by fetched_at desc, id desc) = 1),
 sides as ({side('home')} union all {side('away')}),
 speeds as (select game_pk, day as official_date, avg(mu) as mu from sides group by 1, 2),
 counts as (select game_pk, day as official_date, {R.LEAGUE_PITCHES}::double as mu from slate),
 runs as (select s.game_pk, s.day as official_date, least(coalesce(h.n, 0), coalesce(a.n, 0)) as n, h.rs as hrs, h.ra as hra, a.rs as ars, a.ra as ara, p.factor, {_starter_sql('hp.k', 'hp.w', 'hp.pa')} as hf, {_starter_sql('ap.k', 'ap.w', 'ap.pa')} as af
  from slate s left join team h on h.who = home_team_id and h.day = s.day left join team a on a.who = away_team_id and a.day = s.day left join park p on p.who = venue_id and p.day = s.day
  left join prof hp on hp.who = home_pid and hp.day = s.day left join prof ap on ap.who = away_pid and ap.day = s.day),
 expected as (select game_pk, official_date, {held(f"(({part('hrs')} + {part('ara')}) / 2 * af + ({part('ars')} + {part('hra')}) / 2 * hf) * coalesce({held('factor', R.PARK_RANGE)}, 1.0)", R.RUNS_RANGE)} as full_mu from runs),
 totals as (select game_pk, official_date, round(full_mu, 2) as mu, greatest({R.LEAST_SIGMA}::double, sqrt(2 * full_mu)) as sigma from expected),
 shares as (select s.game_pk, s.day as official_date, greatest(0.05, least(0.95, coalesce(h.pct, 0.5))) as h, greatest(0.05, least(0.95, coalesce(a.pct, 0.5))) as a from slate s left join team h on h.who = home_team_id and h.day = s.day left join team a on a.who = away_team_id and a.day = s.day),
 odds5 as (select *, h * (1 - a) / (h * (1 - a) + a * (1 - h)) as m from shares), home as (select *, m / (1 - m) * (0.542 / (1 - 0.542)) as o from odds5),
 chance as (select game_pk, official_date, greatest(0.05, least(0.95, o / (1 + o))) as p from home),
 picked as (select *, case when p >= 0.5 then 'home' else 'away' end as side, case when p >= 0.5 then p else 1 - p end as ps from chance),
 line_rows as (select game_pk, official_date, 'game_moneyline' as market, round(p, 4) as predicted_value, round(ps, 4) as confidence, side as recommendation, cast(null as double) as line,
  cast(coalesce(q.price_american, round(case when ps >= 0.5 then -100 * ps / (1 - ps) else 100 * (1 - ps) / ps end)) as int) as price, round(ps - {_american('q.price_american')}, 4) as edge, coalesce(q.source, 'model_fair') as book, 'log5_v1' as model_version
  from (select c.*, m.price_american, m.source from picked c left join money m on m.game_pk = c.game_pk and m.outcome = c.side) q)
select *, 'pregame' as phase from (
{_class_sql('pitch_result', _pitch_parts())} union all {_class_sql('ab_result', ab)}
 union all {_line_sql('speeds', 'pitch_speed_ou', 'mu', f'{R.SPEED_SIGMA}::double')} union all {_line_sql('counts', 'ab_pitches_ou', 'mu', f'{R.PITCHES_SIGMA}::double')}
 union all {_line_sql('totals', 'game_total', 'mu', 'sigma')} union all select * from line_rows)"""


_CTX = f"""
{rolling_before('pitcher_id', 'select distinct pitcher_id as who, game_date as day from pitches_v', 'pr')}, {rolling_before('batter_id', 'select distinct batter_id as who, game_date as day from pitches_v', 'br')}"""


def _backfill(t):
    made = S.backfill(t.pitches, t.at_bats, t.games, t.predictions, F.lit("2000-01-01"))
    return made.drop("backfilled_at")


def _backfill_sql() -> str:
    ab_k = f"(case when bk is not null then ({blend_sql('pk', R.LEAGUE_PA['strikeout'], 'pa', R.PITCHER_N)} + {blend_sql('bk', R.LEAGUE_PA['strikeout'], 'ba', R.PITCHER_N)}) / 2 else {blend_sql('pk', R.LEAGUE_PA['strikeout'], 'pa', R.PITCHER_N)} end + 0.08 * two)"
    ab = {"strikeout": ab_k, "walk": f"({blend_sql('pbb', R.LEAGUE_PA['walk'], 'pa', R.PITCHER_N)} + 0.12 * three)", "hit": f"({R.LEAGUE_PA['hit']}::double - 0.04 * two)", "out": f"({R.LEAGUE_PA['out']}::double - 0.04 * two - 0.06 * three)"}
    none = "cast(null as double) as line, cast(null as int) as price, cast(null as double) as edge, cast(null as varchar) as book"

    def classes(market: str, parts: dict[str, str]) -> str:
        total = " + ".join(parts.values())
        shares = ", ".join(f"round(({x}) / ({total}), 6) as {k}" for k, x in parts.items())
        names = " ".join(f"when {k} = most then '{k}'" for k in parts)
        return f"select game_pk, at_bat_index, k as pitch_number, '{market}' as market, most as predicted_value, most as confidence, case {names} end as recommendation, {none}, '{S.VERSION}' as model_version from (select *, greatest({', '.join(parts)}) as most from (select game_pk, at_bat_index, k, {shares} from ctx))"

    def line(market: str, mean: str, sigma: str, where: str = "true") -> str:
        return f"""select game_pk, at_bat_index, k as pitch_number, '{market}' as market, mean as predicted_value, round(greatest(ov, 1 - ov), 4) as confidence, case when ov >= 0.5 then 'over' else 'under' end as recommendation, line, cast(100 as int) as price, round(greatest(ov, 1 - ov) - 0.5, 4) as edge, 'model_fair' as book, '{S.VERSION}' as model_version
 from (select *, {_over('mean', f'{sigma}::double')} as ov from (select *, floor(mean * 2 + 0.5) / 2 as line from (select *, {mean} as mean from ctx where {where})))"""

    speed = f"round({blend_sql('pv', R.LEAGUE_SPEED, 'pp', R.SPEED_N)} - {R.BELOW_FASTBALL} - case when strikes = 2 then {R.TWO_STRIKE_SPEED} else 0.0 end + case when balls = 3 then {R.THREE_BALL_SPEED} else 0.0 end, 2)"
    count = f"round(case when k >= {R.LEAGUE_PITCHES} then k + case when strikes = 2 then {R.STILL_AT_TWO_STRIKES} else {R.STILL_TO_COME} end else {R.LEAGUE_PITCHES} end::double, 2)"
    return f"""
with {_CTX},
 own as (select p.* from pitches_v p where game_pk in (select game_pk from games_v where status = 'Final')),
 ends as (select game_pk, at_bat_index, max(pitch_number) as n, min(pitcher_id) as pitcher_id, min(batter_id) as batter_id, min(game_date) as game_date from own group by 1, 2),
 places as (select game_pk, at_bat_index, pitch_number as k, balls, strikes from own union all select game_pk, at_bat_index, 0, 0, 0 from ends),
 todo as (select x.*, e.pitcher_id, e.batter_id, e.game_date, min(k) over (partition by x.game_pk, x.at_bat_index) as first_k from places x join ends e on e.game_pk = x.game_pk and e.at_bat_index = x.at_bat_index
  where k < n and not exists (select 1 from predictions_v d where d.market = 'pitch_result' and d.game_pk = x.game_pk and d.at_bat_index = x.at_bat_index and d.pitch_number = k)),
 ctx as (select t.*, p.zone_rate as pz, p.k_rate as pk, p.bb_rate as pbb, p.sample_abs as pa, p.sample_pitches as pp, p.avg_fastball_velo as pv, b.k_rate as bk, b.sample_abs as ba, case when strikes >= 2 then 1 else 0 end as two, case when balls >= 3 then 1 else 0 end as three
  from todo t left join pr_form p on p.who = t.pitcher_id and p.day = t.game_date left join br_form b on b.who = t.batter_id and b.day = t.game_date)
{classes('pitch_result', _pitch_parts('balls', 'strikes'))} union all {classes('ab_result', ab)} union all {line('pitch_speed_ou', speed, R.SPEED_SIGMA)} union all {line('ab_pitches_ou', count, R.PITCHES_SIGMA, 'k = first_k')}"""


# --- predictors from frequencies -----------------------------------------------------------------------------------


def _hard_hit(t):
    return t.pitches.groupBy("batter_id").agg((F.count_if(F.col("launch_speed") >= 95) / F.nullif(F.count("launch_speed"), F.lit(0))).alias("hard_hit_rate"))


def _frequency(market):
    def plan(t):
        asked = lambda who: t.pitches.select(who, "game_date").distinct()
        form = [asof.rolling_before(t.pitches, t.at_bats, who, asked(who), speed_digits=DIGITS) for who in ("pitcher_id", "batter_id")]
        shares = A.category_rates(t.pitches, ["pitcher_id"], "result_category", _CATEGORIES, "start_speed", "avg_speed", 600, DIGITS, RATE_DIGITS)
        results = A.category_rates(t.at_bats, ["pitcher_id"], "result", _RESULTS, "pitch_count", "avg_pitches", 200, DIGITS, RATE_DIGITS)
        positions = t.pitches.withColumn("pitch_count_pa", F.col("pitch_number") - 1)
        ctx = Q.context(positions, shares, results, *form, A.matchup_history(t.at_bats, 0), _hard_hit(t))
        out = Q.predict(ctx, market, _KEY, digits=DIGITS)
        return out.withColumn("features_used", F.array_join("features_used", ","))

    return plan


_FREQ = f"""
with {_CTX},
 fp as ({_category_sql('pitches_v', 'pitcher_id', 'result_category', _CATEGORIES, 'start_speed', 'avg_speed', 600)}), fa as ({_category_sql('at_bats_v', 'pitcher_id', 'result', _RESULTS, 'pitch_count', 'avg_pitches', 200)}),
 met as (select pitcher_id, batter_id, count(*) as pa, sum(cast(result = 'strikeout' as int)) as so, sum(cast(result = 'walk' as int)) as bb, sum(cast(result = 'hit' as int)) as h from at_bats_v group by 1, 2 having count(*) >= 3),
 hh as (select batter_id, sum(cast(launch_speed >= 95 as int)) / nullif(count(launch_speed), 0) as hard from pitches_v group by 1),
 c as (select p.game_pk, p.at_bat_index, p.pitch_number, p.balls, p.strikes, p.pitch_number - 1 as now, case when bat_side = 'S' then 'opposite' when bat_side = pitch_hand then 'same' else 'opposite' end as hands,
  fp.n as fn, fp.avg_speed, fp.strike_foul_rate, fp.ball_rate, fp.in_play_rate, fa.n as an, fa.avg_pitches, fa.so_rate, fa.bb_rate, fa.hit_rate, fa.out_rate,
  pf.sample_pitches as pn, pf.zone_rate as pz, pf.avg_fastball_velo as pv, bf.chase_rate as bc, bf.k_rate as bk, hard, met.pa as mpa, met.so as mso, met.bb as mbb, met.h as mh
  from pitches_v p left join fp on fp.pitcher_id = p.pitcher_id left join fa on fa.pitcher_id = p.pitcher_id left join pr_form pf on pf.who = p.pitcher_id and pf.day = p.game_date left join br_form bf on bf.who = p.batter_id and bf.day = p.game_date
  left join met on met.pitcher_id = p.pitcher_id and met.batter_id = p.batter_id left join hh on hh.batter_id = p.batter_id)"""


def _blend500(v: str, league: float, n: str) -> str:
    return f"((0.85::double * (1 - exp(-({n})::double / 500))) * {v} + (1 - 0.85::double * (1 - exp(-({n})::double / 500))) * {league})"


def _conf(market: str) -> str:
    return f"round(0.5 + 0.32 * (1 - exp(-n::double / {Q.CONFIDENCE_N[market]})), {DIGITS}) as confidence, cast(n as bigint) as sample_size, 'freq_v2' as model_version, '{market}' as market"


def _list(base: str, **parts: str) -> str:
    return f"array_to_string(list_filter([case when {base} then 'pitcher_freq' else 'league_avg' end, {', '.join(f'''case when {c} then '{k}' end''' for k, c in parts.items())}], lambda x: x is not null), ',') as features_used"


def _chain(steps: list[tuple[str, str, dict[str, str]]], classes: list[str], start: str) -> str:
    """Successive tables: each (name, condition, changed chances) makes the changed ones add up to one where its condition holds."""
    out, last = start, "s0"
    for name, condition, new in steps:
        changed = {k: new.get(k, k) for k in classes}
        total = " + ".join(f"({x})" for x in changed.values())
        parts = ", ".join(f"case when {condition} then ({x}) / ({total}) else {k} end as {k}" for k, x in changed.items())
        out += f", {name} as (select * exclude ({', '.join(classes)}), {parts} from {last})"
        last = name
    return out


def _when_counts(shifts: dict, k: str) -> str:
    return "greatest(0.0, " + k + " + case " + " ".join(f"when balls = {b} and strikes = {s} then {d.get(k, 0.0)}" for (b, s), d in shifts.items()) + " else 0.0 end)"


def _counts(shifts: dict) -> str:
    return "(" + " or ".join(f"(balls = {b} and strikes = {s})" for b, s in shifts) + ")"


def _moving(shifts: dict, classes: list[str]) -> dict[str, str]:
    # a class that a count leaves alone stays as it is, as none is below zero
    return {k: _when_counts(shifts, k) for k in classes}


_PITCHES = list(R.LEAGUE_PITCH)
_PAS = list(R.LEAGUE_PA)


def _start(values: dict[str, str], league: dict[str, float], known: str, n: str) -> str:
    own = {k: f"case when {known} then {_blend500(c, league[k], n)} else {league[k]}::double end" for k, c in values.items()}
    total = " + ".join(own.values())
    return f"s0 as (select *, {', '.join(f'({x}) / ({total}) as {k}' for k, x in own.items())} from c)"


_RESULT_SQL = (
    _FREQ
    + ", "
    + _chain(
        [
            ("s1", "coalesce(pz > 0.55 or pz < 0.42, false)", {"strike_foul": "strike_foul + case when pz > 0.55 then 0.04 else 0.0 end", "ball": "ball + case when pz < 0.42 then 0.06 else 0.0 end"}),
            ("s2", "coalesce(bc > 0.33 or bc < 0.22, false)", {"strike_foul": "strike_foul + case when bc > 0.33 then 0.05 else 0.0 end", "ball": "ball + case when bc < 0.22 then 0.03 else 0.0 end"}),
            ("s3", _counts(R.COUNT_SHIFTS), _moving(R.COUNT_SHIFTS, _PITCHES)),
        ],
        _PITCHES,
        _start({"strike_foul": "strike_foul_rate", "ball": "ball_rate", "in_play": "in_play_rate"}, R.LEAGUE_PITCH, "fn is not null", "fn"),
    )
    + f""" select game_pk, at_bat_index, pitch_number, {', '.join(f'round({k}, {DIGITS}) as p_{k}' for k in _PITCHES)}, {_conf('pitch_result')}, {_list('fn is not null', pitcher_rolling='coalesce(pz > 0.55 or pz < 0.42, false)', batter_rolling='coalesce(bc > 0.33 or bc < 0.22, false)')}
 from (select *, greatest(coalesce(fn, 0), case when pz is not null then coalesce(pn, 0) else 0 end) as n from s3)"""
)
_AT_BAT_SQL = (
    _FREQ
    + ", "
    + _chain(
        [
            ("s1", "hands = 'same'", {"strikeout": "strikeout + 0.03", "walk": "greatest(0.0, walk - 0.01)"}),
            ("s2", "hands = 'opposite'", {"strikeout": "greatest(0.0, strikeout - 0.02)", "walk": "walk + 0.015"}),
            ("s3", "coalesce(mpa >= 10, false)", {"strikeout": "0.7 * strikeout + 0.3 * (mso / mpa)", "walk": "0.7 * walk + 0.3 * (mbb / mpa)", "hit": "0.7 * hit + 0.3 * (mh / mpa)", '"out"': '0.7 * "out" + 0.3 * greatest(0.0, 1 - mso / mpa - mbb / mpa - mh / mpa)'}),
            ("s4", "coalesce(hard > 0.4, false) or coalesce(bk > 0.3, false)", {"hit": "hit + case when hard > 0.4 then 0.03 else 0.0 end", "strikeout": "strikeout + case when bk > 0.3 then 0.025 else 0.0 end"}),
            ("s5", _counts(Q.PA_SHIFTS), {('"out"' if k == "out" else k): x.replace("out +", '"out" +') if k == "out" else x for k, x in _moving(Q.PA_SHIFTS, _PAS).items()}),
        ],
        ["strikeout", "walk", "hit", '"out"'],
        _start({"strikeout": "so_rate", "walk": "bb_rate", "hit": "hit_rate", "out": "out_rate"}, R.LEAGUE_PA, "an is not null", "an"),
    )
    + f""" select game_pk, at_bat_index, pitch_number, {', '.join(f'round("{k}", {DIGITS}) as p_{k}' for k in _PAS)}, {_conf('ab_result')}, {_list('an is not null', platoon='hands is not null', matchup='coalesce(mpa >= 10, false)', batter_rolling='coalesce(hard > 0.4, false) or coalesce(bk > 0.3, false)')}
 from (select *, coalesce(an, 0) as n from s5)"""
)
_SPEED_SQL = f"""{_FREQ}, s as (select *, case when pv is not null then greatest(coalesce(fn, 0), coalesce(pn, 0)) else coalesce(fn, 0) end as n, coalesce(pv, avg_speed, 92.8::double) as own from c)
select game_pk, at_bat_index, pitch_number, round({_blend500('own', 92.8, 'n')} + case when balls = 3 and strikes = 0 then 0.3 when balls = 0 and strikes = 2 then -0.4 when balls = 1 and strikes = 2 then -0.2 else 0.0 end, {DIGITS}) as predicted_mph, {_conf('pitch_speed_ou')},
 {_list('fn is not null', pitcher_rolling='pv is not null')} from s"""
_COUNT_SQL = f"""{_FREQ}, s as (select *, coalesce(an, 0) as n, coalesce(pz < 0.45, false) as few, coalesce(bc < 0.25, false) as patient from c),
 b as (select *, {_blend500('coalesce(avg_pitches, 3.85::double)', 3.85, 'n')} + case when few then 0.4 else 0.0 end + case when patient then 0.3 else 0.0 end as base from s)
select game_pk, at_bat_index, pitch_number, round(case when now >= base then now + case when balls = 3 and strikes = 2 then 1.2 when strikes = 2 then 1.3 else 1.6 end else base end, {DIGITS}) as predicted_count, now as current_pitch_count, {_conf('ab_pitches_ou')},
 {_list('an is not null', pitcher_rolling='few', batter_rolling='patient')} from b"""

PLANS = {
    "r12_slate_scores": (_slate, _slate_sql()),
    "r16_backfilled_calls": (_backfill, _backfill_sql()),
    "r7_frequency_speed": (_frequency("pitch_speed_ou"), _SPEED_SQL),
    "r7_frequency_pitch_result": (_frequency("pitch_result"), _RESULT_SQL),
    "r7_frequency_pa_result": (_frequency("ab_result"), _AT_BAT_SQL),
    "r7_frequency_pa_pitches": (_frequency("ab_pitches_ou"), _COUNT_SQL),
}
