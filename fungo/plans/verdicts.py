"""Queries of ledger verdicts and of stored fits, with the same answers in SQL."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fungo.operators import evaluators as V
from fungo.operators import features as X
from fungo.operators import ledger as L
from fungo.operators import markets
from fungo.operators import quality as Q
from fungo.plans.boards import _LEDGER, _SCORED_SQL, _ledger
from fungo.plans.market import _cdf

NOW = "1998-08-04 15:00:00"


def _checked(t):
    return _ledger(t).withColumn("verified_at", F.when(F.dayofmonth("day") % 4 != 0, F.col("ingested_at")))


def _verdicts(t):
    rows = _checked(t)
    found = L.verdicts(rows, Q.scored_days(Q.ingest_frame(rows)), F.lit(NOW))
    return found.withColumn("evidence", F.array_join("evidence", ";"))


def _level(x: str, warn: float, fail: float, op: str = ">=") -> str:
    return f"case when {x} {op} {fail} then 'fail' when {x} {op} {warn} then 'warn' else 'pass' end"


_LIST = "coalesce(array_to_string(list_sort(list({name}) filter (where {bad})), ';'), '') as evidence"
_WORST = "['pass', 'warn', 'fail'][1 + coalesce(max(case {c} when 'fail' then 2 when 'warn' then 1 else 0 end), 0)]"
_FILE = "concat_ws(':', dataset, cast(day as varchar))"
_VERDICTS_SQL = f"""
with l as (select *, case when day(day) % 4 <> 0 then ingested_at end as verified_at from ({_LEDGER})), sc as ({_SCORED_SQL}),
 extra as (select dataset, day, round(date_diff('second', day::timestamp, ingested_at) / 86400, 6) as lag_days, count(*) over (partition by dataset, cast(ingested_at as date)) > {Q.BACKFILL_FILES} as bulk from l),
 recent as (select sc.*, lag_days, bulk from sc join extra using (dataset, day) qualify row_number() over (partition by dataset order by day desc) <= {L.RECENT_DAYS}),
 late as (select l.* from l qualify row_number() over (partition by dataset order by day desc) <= {L.VERIFY_DAYS}),
 days as (select day, {', '.join(f"max({c}) filter (where dataset = '{d}') as {d}_{k}" for d in L.DATASETS for k, c in (('rows', 'rows_n'), ('games', 'games')))} from l group by 1 order by 1 desc limit {L.RECENT_DAYS}),
 marked as (select day, concat_ws(', ', case when at_bats_rows is null then 'at_bats' end, case when games_rows is null then 'games' end, case when pitches_rows is null then 'pitches' end) as missing,
  coalesce(pitches_games = games_games and at_bats_games = games_games, false) and coalesce(pitches_rows / at_bats_rows between {L.PITCHES_PER_PA[0]} and {L.PITCHES_PER_PA[1]}, false) and coalesce(at_bats_rows / games_games between {L.PA_PER_GAME[0]} and {L.PA_PER_GAME[1]}, false) as fine from days),
 al as (select case when missing <> '' or not fine then 1 else 0 end as bad, * from marked),
 have as (select distinct day from l where dataset = 'games'), span as (select year(day) as season, min(day) as a, max(day) as b from have group by 1),
 gone as (select cast(d as date) as d from span, unnest(generate_series(a::timestamp, b::timestamp, interval 1 day)) u(d) where cast(d as date) not in (select day from have)),
 runs as (select year(d) as season, min(d) as a, max(d) as b, count(*) as n from (select d, d - cast(row_number() over (partition by year(d) order by d) as int) as run from gone) group by year(d), run),
 near as (select * from runs where b >= date '{NOW[:10]}' - {L.GAP_DAYS}),
 hours as (select date_diff('second', max(ingested_at), timestamp '{NOW}') / 3600.0 as h from l), cur as (select max(day) as d, date_diff('day', max(day), date '{NOW[:10]}') as k from l)
select 'freshness' as "check", case when h < -1 then 'warn' else {_level('h', L.WRITE_WARN_HOURS, L.WRITE_FAIL_HOURS, '>')} end as status, case when h < -1 then printf('newest write %.1fh in the future', -h) else printf('last write %.1fh ago', h) end as headline, '' as evidence from hours
union all select 'currency', {_level('k', L.BEHIND_WARN_DAYS, L.BEHIND_FAIL_DAYS)}, 'newest game day ' || cast(d as varchar) || ', ' || k || 'd behind', '' from cur
union all select 'volume', {_WORST.format(c='rows_per_game_status')}, case when count(*) filter (where rows_per_game_status <> 'pass') = 0 then 'rows per game normal across ' || count(*) || ' recent files' else count(*) filter (where rows_per_game_status <> 'pass') || ' file(s) off baseline' end, {_LIST.format(name=_FILE, bad="rows_per_game_status <> 'pass'")} from recent
union all select 'size', {_WORST.format(c='bytes_per_row_status')}, case when count(*) filter (where bytes_per_row_status <> 'pass') = 0 then 'bytes per row normal across ' || count(*) || ' recent files' else count(*) filter (where bytes_per_row_status <> 'pass') || ' file(s) off baseline' end, {_LIST.format(name=_FILE, bad="bytes_per_row_status <> 'pass'")} from recent
union all select 'lag', {_WORST.format(c='lag_days_status')}, coalesce(printf('median lag %.1fd over %d nightly files', round(quantile_cont(lag_days, 0.5) filter (where not bulk), 1), count(*) filter (where not bulk)), 'no nightly writes'), {_LIST.format(name=_FILE, bad="lag_days_status <> 'pass'")} from recent
union all select 'alignment', case when sum(bad) = 0 then 'pass' when count(*) filter (where bad = 1 and missing <> '') > 0 then 'fail' else 'warn' end, case when sum(bad) = 0 then 'all datasets agree on every recent day' else cast(sum(bad) as int) || ' recent day(s) disagree' end, {_LIST.format(name="concat_ws(':', nullif(missing, ''), cast(day as varchar))", bad='bad = 1')} from al
union all select 'verification', case when count(verified_at) = count(*) then 'pass' when count(verified_at) > 0 then 'warn' else 'fail' end, count(verified_at) || ' of ' || count(*) || ' newest files verified', {_LIST.format(name=_FILE, bad='verified_at is null')} from late
union all select 'gaps', {_level('coalesce(sum(n), 0)', L.GAP_WARN, L.GAP_FAIL)}, case when coalesce(sum(n), 0) = 0 then 'no missing days in the last {L.GAP_DAYS}' else cast(sum(n) as int) || ' missing day(s) in the last {L.GAP_DAYS}' end, {_LIST.format(name="concat_ws('..', cast(a as varchar), cast(b as varchar))", bad='true')} from near"""

#: Parameters as a registry would hold them; each market has an older and a newer version.
_PITCH = {"type": "multinomial_logistic", "classes": ["strike_foul", "ball", "in_play"], "features": ["balls", "strikes", "two_strikes", "pitcher_zone_delta"]}
PARAMS = [
    ("pr_old", "pitch_result", _PITCH | {"coef": [[-0.02, 0.05, 0.1, 0.9], [0.03, -0.1, 0.02, -1.1], [0.0, 0.04, -0.06, 0.2]], "intercept": [0.4, 0.1, -0.5], "form_window": "career"}, False),
    ("pr_new", "pitch_result", _PITCH | {"coef": [[-0.01, 0.02, 0.2, 1.4], [0.05, -0.03, 0.0, -0.8], [0.02, 0.01, -0.2, -0.6]], "intercept": [0.35, 0.2, -0.4], "form_window": "d90"}, True),
    ("sp_old", "pitch_speed_ou", {"type": "linear", "features": ["pitcher_velo", "strikes", "pitch_of_pa"], "coef": [0.4, -0.1, 0.02], "intercept": 53.0, "sigma": 5.4, "form_window": "career"}, False),
    ("sp_new", "pitch_speed_ou", {"type": "linear", "features": ["pitcher_velo", "balls"], "coef": [0.2, 0.05], "intercept": 71.5, "sigma": 5.8, "form_window": "d30"}, True),
    ("ap_new", "ab_pitches_ou", {"type": "remaining_table", "table": {f"{b}-{s}": {"mean": 2.0, "dist": {"1": 0.3 + 0.05 * s, "2": 0.35 - 0.05 * s + 0.02 * b, "3": 0.2}} for b in range(4) for s in range(2)}}, True),
    ("ml_new", "game_moneyline", {"type": "log5", "home_adv": 0.535}, True),
]


def _all(t, fits: DataFrame) -> list[DataFrame]:
    return [V.scored(markets.cells_of(m, t.pitches, t.at_bats, t.games), fits, s) for m, s in markets.SPECS.items() if m != "ab_result"]


def _evaluated(t):
    fits = V.stored_fits(t.spark, [(i, m, p) for i, m, p, _ in PARAMS])
    return reduce(DataFrame.unionByName, _all(t, fits))


def _baselines(t):
    registry = t.spark.createDataFrame([(m, i, active, json.dumps(p)) for i, m, p, active in PARAMS], "market string, version string, is_active boolean, params string")
    found = [V.baseline(markets.cells_of(m, t.pitches, t.at_bats, t.games), registry, s, skip=(1995,)) for m, s in markets.SPECS.items() if m != "ab_result"]
    return reduce(DataFrame.unionByName, found)



def _form(days: str, value: str, weight: str) -> str:
    """Trailing means over the days before: a career's, 30 and 90 days'."""
    frame = lambda name, lower: f"cast(sum({value} * {weight}) over (partition by who order by day range between {lower} and interval 1 day preceding) as double) / nullif(sum({weight}) over (partition by who order by day range between {lower} and interval 1 day preceding), 0) as {name}"
    return f"select who, day, {frame('career', 'unbounded preceding')}, {frame('d30', 'interval 30 day preceding')}, {frame('d90', 'interval 90 day preceding')} from ({days})"


def _bucket(window: str, base: float, step: float) -> str:
    return f"cast(floor(round(coalesce({window} - {base}, 0.0) / {step}, 9)) as int)"


_ZONE_DAYS = "select pitcher_id as who, game_date as day, cast(round(avg(case when zone between 1 and 9 then 1.0 else 0.0 end), 9) as decimal(18,9)) as m, count(*) as n from pitches_v group by 1, 2"
_SPEED_DAYS = "select pitcher_id as who, game_date as day, cast(round(avg(start_speed), 9) as decimal(18,9)) as m, count(*) as n from pitches_v group by 1, 2"


def _logit_rows(fit: tuple) -> str:
    name, _, p, _ = fit
    inputs = {"balls": "balls", "strikes": "strikes", "two_strikes": "cast(strikes >= 2 as int)", "three_balls": "cast(balls >= 3 as int)", "pitcher_zone_delta": f"({_bucket(p['form_window'], X.ZONE_BASE, X.ZONE_STEP)} * {X.ZONE_STEP}::double)"}
    z = [" + ".join([f"{b}::double", *(f"{w}::double * {inputs[f]}" for f, w in zip(p["features"], row, strict=True))]) for row, b in zip(p["coef"], p["intercept"], strict=True)]
    parts = ", ".join(f"exp({x}) as e{i}" for i, x in enumerate(z))
    return f"select '{name}' as fit_id, season, outcome, e0 / (e0 + e1 + e2) as p0, e1 / (e0 + e1 + e2) as p1, e2 / (e0 + e1 + e2) as p2 from (select season, outcome, {parts} from zoned)"


def _speed_rows(fit: tuple) -> str:
    name, _, p, _ = fit
    inputs = {"balls": "balls", "strikes": "strikes", "pitch_of_pa": "pitch_of_pa", "pitcher_velo": f"({X.SPEED_BASE}::double + {p['form_window']}_b * {X.SPEED_STEP}::double)"}
    mu = " + ".join([f"{p['intercept']}::double", *(f"{w}::double * {inputs[f]}" for f, w in zip(p["features"], p["coef"], strict=True))])
    return f"select '{name}' as fit_id, season, n, ms, sqrt(greatest(vs, 1e-12)) as sd, {mu} as mu, {p['sigma']}::double as sigma from cells"


def _scores_sql() -> str:
    pr, sp = ([f for f in PARAMS if f[1] == m] for m in ("pitch_result", "pitch_speed_ou"))
    table = next(f for f in PARAMS if f[1] == "ab_pitches_ou")
    money = next(f for f in PARAMS if f[1] == "game_moneyline")
    dist = ", ".join(f"('{state}', {k}, {v}::double)" for state, e in table[2]["table"].items() for k, v in e["dist"].items())
    adv = f"{money[2]['home_adv']}::double"
    inside = f"({_cdf('((sigma - (ms - mu)) / sd)')}) - ({_cdf('((-sigma - (ms - mu)) / sd)')})"
    long = lambda source, metrics: " union all ".join(f"select fit_id, season, '{k}' as metric, cast({x} as double) as value, cast(n as double) as n from {source}" for k, x in metrics.items())
    return f"""
zform as ({_form(_ZONE_DAYS, 'm', 'n')}), sform as ({_form(_SPEED_DAYS, 'm', 'n')}),
zoned as (select cast(year(game_date) as int) as season, balls, strikes, case when is_in_play then 'in_play' when is_ball then 'ball' else 'strike_foul' end as outcome, career, d30, d90 from pitches_v p join zform f on f.who = p.pitcher_id and f.day = p.game_date where career is not null),
soft as ({' union all '.join(_logit_rows(f) for f in pr)}),
told as (select *, case outcome when 'strike_foul' then p0 when 'ball' then p1 else p2 end as own, pow(p0 - cast(outcome = 'strike_foul' as int), 2) + pow(p1 - cast(outcome = 'ball' as int), 2) + pow(p2 - cast(outcome = 'in_play' as int), 2) as sq, least(9, floor(p1 * 10)) as bin from soft),
binned as (select fit_id, season, bin, count(*) as n, sum(-ln(greatest(own, 1e-12))) as loss, sum(sq) as sq, abs(round(avg(p1), 5) - round(avg(cast(outcome = 'ball' as int)), 5)) * count(*) as gap from told group by 1, 2, 3),
multi as (select fit_id, season, sum(loss) as loss, sum(sq) as sq, sum(gap) as gap, sum(n) as n from binned group by 1, 2),
cells as (select cast(year(game_date) as int) as season, balls, strikes, least(pitch_number, 10) as pitch_of_pa, {', '.join(f"{_bucket(w, X.SPEED_BASE, X.SPEED_STEP)} as {w}_b" for w in markets.WINDOWS)}, round(avg(start_speed), 6) as ms, round(coalesce(var_pop(start_speed), 0), 6) as vs, count(*) as n
 from pitches_v p join sform f on f.who = p.pitcher_id and f.day = p.game_date where career is not null and start_speed is not null group by all),
fast as ({' union all '.join(_speed_rows(f) for f in sp)}),
lin as (select fit_id, season, sqrt(sum(n * pow(ms - mu, 2)) / sum(n)) as rmse, any_value(sigma) as sigma, sum(n * ({inside})) / sum(n) as inside, sum(n) as n from fast group by 1, 2),
dist(state, remaining, p) as (values {dist}),
left_ as (select cast(year(p.game_date) as int) as season, p.balls, p.strikes, least(a.pitch_count - p.pitch_number + 1, {X.MOST_REMAINING}) as remaining from pitches_v p join at_bats_v a on a.game_pk = p.game_pk and a.at_bat_index = p.at_bat_index where a.pitch_count between 1 and 30 and p.pitch_number <= a.pitch_count and p.balls between 0 and 3 and p.strikes between 0 and 2),
tab as (select '{table[0]}' as fit_id, season, sum(-ln(least(1.0, greatest(1e-12, coalesce(d.p, 0.0))))) / count(*) as loss, count(*) as n from left_ l left join dist d on d.state = l.balls || '-' || l.strikes and d.remaining = l.remaining group by 2),
ml as (select '{money[0]}' as fit_id, season, sum(pow({adv} - cast(home_score > away_score as int), 2)) / count(*) as sq, count(*) as n from games_v where home_score <> away_score group by 2),
scores as ({long('multi', {'logloss': 'round(loss / n, 6)', 'brier': 'round(sq / n, 6)', 'ece': 'round(gap / n, 6)'})} union all {long('lin', {'rmse': 'round(rmse, 6)', 'sigma': 'round(sigma, 4)', 'sigma_coverage': 'round(inside, 5)'})}
 union all {long('tab', {'logloss': 'round(loss, 6)', 'states': str(len(table[2]['table']))})} union all {long('ml', {'brier': 'round(sq, 6)', 'home_adv': f'round({adv}, 4)'})})"""


PLANS = {
    "q15_ledger_verdicts": (_verdicts, _VERDICTS_SQL),
    "q15_overall": (
        lambda t: L.overall(L.verdicts(_checked(t), Q.scored_days(Q.ingest_frame(_checked(t))), F.lit(NOW))),
        f"""with v as ({_VERDICTS_SQL}), c as (select count(*) as n, count(*) filter (where status = 'fail') as f, count(*) filter (where status = 'warn') as w from v)
select case when f > 0 then 'fail' when w > 0 then 'warn' else 'pass' end as status, case when f + w = 0 then n || ' checks pass' else concat_ws(', ', case when f > 0 then f || ' failing' end, case when w > 0 then w || ' to watch' end) || ' of ' || n || ' checks' end as summary from c""",
    ),
    "m18_evaluated_fits": (_evaluated, f"with {_scores_sql()} select * from scores"),
    "m24_baselines": (
        _baselines,
        f"with {_scores_sql()} select fit_id, metric, round(sum(value * n) filter (where season <> 1995) / sum(n) filter (where season <> 1995), 6) as value, cast(count(*) filter (where season <> 1995) as int) as folds_used, cast(count(*) filter (where season = 1995) as int) as folds_excluded, sum(n) filter (where season <> 1995) as n from scores where fit_id in ({', '.join(repr(i) for i, _, _, active in PARAMS if active)}) group by 1, 2",
    ),
}
