"""Queries over quotes, prices, scores and flattened feeds, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.operators import aggregates as A
from fungo.operators import asof
from fungo.operators import pricing as R
from fungo.plans.display import DIGITS, SEASON, rolling_before
from fungo.sources import play_by_play as N

_IMPLIED = "case when price_american < 0 then -price_american / (100.0 - price_american) else 100.0 / (100 + price_american) end"
_QUOTES = f"""
lat as (select * from odds_v qualify row_number() over (partition by game_pk, market, source, outcome order by fetched_at desc, id desc) = 1),
imp as (select *, {_IMPLIED} as implied_prob from lat),
fair as (select *, case when count(*) over w = 2 then round(implied_prob / sum(implied_prob) over w, 4) else implied_prob end as novig_prob from imp window w as (partition by game_pk, market, source))"""
_WINS = f"""
s as (select home_team_id as team_id, home_score as rs, away_score as ra from games_v where season = {SEASON} and status like 'Final%' and game_type = 'R' union all select away_team_id, away_score, home_score from games_v where season = {SEASON} and status like 'Final%' and game_type = 'R'),
wp as (select team_id, case when count(*) >= 10 then round(avg(case when rs > ra then 1.0 else 0.0 end), 4) end as pct from s group by 1),
lg as (select game_pk, greatest(0.05, least(0.95, h.pct)) as h, greatest(0.05, least(0.95, a.pct)) as a from games_v g join wp h on h.team_id = home_team_id join wp a on a.team_id = away_team_id where h.pct is not null and a.pct is not null),
n5 as (select game_pk, h * (1 - a) / (h * (1 - a) + a * (1 - h)) as n from lg),
l5 as (select game_pk, greatest(0.05, least(0.95, (n / (1 - n) * (0.542 / (1 - 0.542))) / (1 + n / (1 - n) * (0.542 / (1 - 0.542))))) as p_home from n5)"""
_CDF = "case when {x} > 0 then 1 - {tail} else {tail} end"


def _cdf(x: str) -> str:
    t = f"(1 / (1 + 0.2316419::double * abs({x})))"
    tail = f"(0.3989423::double * exp(-({x}) * ({x}) / 2) * ({t} * (0.3193815 + {t} * (-0.3565638 + {t} * (1.781478 + {t} * (-1.821256 + {t} * 1.330274))))))"
    return f"case when {x} > 0 then 1 - {tail} else {tail} end"


def _quotes(t):
    return R.without_margin(R.latest_quotes(t.odds, ["game_pk", "market", "source", "outcome"]))


def _context(t):
    """Each pitch with the rolling figures of the days before its own."""
    form = [asof.rolling_before(t.pitches, t.at_bats, who, t.pitches.select(who, "game_date").distinct(), speed_digits=DIGITS) for who in ("pitcher_id", "batter_id")]
    return R.scoring_context(t.pitches, *form, day="game_date")


_CTX = f"""
{rolling_before('pitcher_id', 'select distinct pitcher_id as who, game_date as day from pitches_v', 'pr')}, {rolling_before('batter_id', 'select distinct batter_id as who, game_date as day from pitches_v', 'br')},
ctx as (select p.game_pk, p.at_bat_index, p.pitch_number, p.balls, p.strikes, p.pitch_number - 1 as pitch_count_pa, ps.zone_rate as pz, ps.k_rate as pk, ps.bb_rate as pbb, ps.sample_abs as pa, ps.sample_pitches as pp, ps.avg_fastball_velo as pv, bs.k_rate as bk, bs.sample_abs as ba
 from pitches_v p left join pr_form ps on ps.who = p.pitcher_id and ps.day = p.game_date left join br_form bs on bs.who = p.batter_id and bs.day = p.game_date)"""


def shift_sql(k: str) -> str:
    return "case " + " ".join(f"when balls = {b} and strikes = {s} then {d[k]}" for (b, s), d in R.COUNT_SHIFTS.items()) + " else 0.0 end"


def blend_sql(v: str, league: float, n: str, k: float) -> str:
    w = f"(0.85::double * (1 - exp(-coalesce({n}, 0)::double / {k})))"
    return f"case when {v} is null then {league}::double else {w} * {v} + (1 - {w}) * {league} end"


_KEY = ["game_pk", "at_bat_index", "pitch_number"]


def _scored(t, probs):
    ctx = _context(t)
    name, most = R.top_class(probs)
    return ctx.select(*_KEY, *(F.round(p, 6).alias(f"p_{k}") for k, p in probs.items()), F.round(most, 6).alias("confidence"))


PLANS = {
    "j9_latest_quote": (
        lambda t: R.latest_quotes(t.odds, ["game_pk", "market", "source", "outcome"]),
        "select * from odds_v qualify row_number() over (partition by game_pk, market, source, outcome order by fetched_at desc, id desc) = 1",
    ),
    "f8_odds_conversion": (
        lambda t: t.odds.select("id", "price_american", F.round(P.american_to_probability(F.col("price_american")), 8).alias("p"), P.probability_to_american(P.american_to_probability(F.col("price_american"))).alias("back")),
        f"with p as (select id, price_american, {_IMPLIED} as p from odds_v) select id, price_american, round(p, 8) as p, cast(case when p >= 0.5 then round(-100 * p / (1 - p)) else round(100 * (1 - p) / p) end as int) as back from p",
    ),
    "r11_without_margin": (
        lambda t: _quotes(t).select("id", "source", "outcome", F.round("implied_prob", 8).alias("implied_prob"), F.round("novig_prob", 8).alias("novig_prob")),
        f"with {_QUOTES} select id, source, outcome, round(implied_prob, 8) as implied_prob, round(novig_prob, 8) as novig_prob from fair",
    ),
    "f16_log5_home_chance": (
        lambda t: A.season_win_share(t.games, SEASON).select(F.col("team_id").alias("home_team_id"), F.col("win_pct").alias("h")).crossJoin(F.broadcast(A.season_win_share(t.games, SEASON).select(F.col("team_id").alias("away_team_id"), F.col("win_pct").alias("a")))).select("home_team_id", "away_team_id", F.round(P.log5(F.col("h"), F.col("a")), 8).alias("p_home")),
        f"with {_WINS}, c as (select h.team_id as home_team_id, a.team_id as away_team_id, case when h.pct is not null and a.pct is not null then greatest(0.05, least(0.95, h.pct)) end as h, greatest(0.05, least(0.95, a.pct)) as a from wp h cross join wp a), m as (select *, h * (1 - a) / (h * (1 - a) + a * (1 - h)) as n from c) select home_team_id, away_team_id, case when n is not null then round(greatest(0.05, least(0.95, (n / (1 - n) * (0.542 / (1 - 0.542))) / (1 + n / (1 - n) * (0.542 / (1 - 0.542))))), 8) end as p_home from m",
    ),
    "r13_moneyline_picks": (
        lambda t: R.moneyline_picks(_quotes(t), t.games, A.season_win_share(t.games, SEASON)),
        f"with {_QUOTES}, {_WINS}, b as (select * from fair qualify row_number() over (partition by game_pk, outcome order by novig_prob, source) = 1), j as (select b.game_pk, outcome as recommendation, source as book, price_american as price, case when outcome = 'home' then p_home else 1 - p_home end as p, novig_prob from b join l5 on l5.game_pk = b.game_pk) select game_pk, recommendation, book, price, round(p, 4) as confidence, round(p - novig_prob, 4) as edge from j where round(p - novig_prob, 4) >= 0.05",
    ),
    "v20_best_edge": (
        lambda t: R.edge_board(_quotes(t).where("outcome = 'home'"), t.games.select("game_pk", F.lit("game_moneyline").alias("market"), (F.lit(0.3) + (F.col("game_pk") % 40) / 100).alias("model_prob")), ["game_pk", "market"]),
        f"with {_QUOTES}, e as (select game_pk, market, source, price_american, novig_prob, round((0.3::double + (game_pk % 40) / 100) - novig_prob, 4) as edge from fair where outcome = 'home') select * from e qualify row_number() over (partition by game_pk, market order by edge desc, source desc) = 1",
    ),
    "v7_odds_board": (
        lambda t: _quotes(t).groupBy("game_pk").agg(F.count("*").alias("quotes"), F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "source", "outcome"))), ",").alias("sides"), F.round(F.max("novig_prob"), 8).alias("top_prob")),
        f"with {_QUOTES} select game_pk, count(*) as quotes, array_to_string(list_sort(list(distinct concat_ws(':', source, outcome))), ',') as sides, round(max(novig_prob), 8) as top_prob from fair group by 1",
    ),
    "f10_normal_cdf": (
        lambda t: t.pitches.where("start_speed is not null").select(*_KEY, F.round(P.normal_cdf((F.col("start_speed") - 92.8) / 5.4), 9).alias("p")),
        f"select game_pk, at_bat_index, pitch_number, round({_cdf('((start_speed - 92.8) / 5.4::double)')}, 9) as p from pitches_v where start_speed is not null",
    ),
    "r1_pitch_result_scores": (
        lambda t: _scored(t, R.pitch_result_probs()),
        f"with {_CTX}, r as (select *, greatest(0.0, 0.455::double + {shift_sql('strike_foul')}) + case when pz > 0.52 then 0.03 else 0 end as sf, greatest(0.0, 0.352::double + {shift_sql('ball')}) + case when pz < 0.44 then 0.04 else 0 end as b, greatest(0.0, 0.193::double + {shift_sql('in_play')}) as ip from ctx) select game_pk, at_bat_index, pitch_number, round(sf / (sf + b + ip), 6) as p_strike_foul, round(b / (sf + b + ip), 6) as p_ball, round(ip / (sf + b + ip), 6) as p_in_play, round(greatest(sf, b, ip) / (sf + b + ip), 6) as confidence from r",
    ),
    "r2_pa_result_scores": (
        lambda t: _scored(t, R.pa_result_probs()),
        f"with {_CTX}, r as (select *, {blend_sql('pk', 0.221, 'pa', 150.0)} as k0, {blend_sql('bk', 0.221, 'ba', 150.0)} as k1, {blend_sql('pbb', 0.087, 'pa', 150.0)} as w0, case when strikes >= 2 then 1 else 0 end as two, case when balls >= 3 then 1 else 0 end as three from ctx), q as (select *, case when bk is not null then (k0 + k1) / 2 else k0 end + 0.08 * two as k, w0 + 0.12 * three as w, 0.239::double - 0.04 * two as h, 0.453::double - 0.04 * two - 0.06 * three as o from r) select game_pk, at_bat_index, pitch_number, round(k / (k + w + h + o), 6) as p_strikeout, round(w / (k + w + h + o), 6) as p_walk, round(h / (k + w + h + o), 6) as p_hit, round(o / (k + w + h + o), 6) as p_out, round(greatest(k, w, h, o) / (k + w + h + o), 6) as confidence from q",
    ),
    "r3_r8_speed_over_line": (
        lambda t: (lambda ctx, ms: ctx.withColumn("mu", P.rounded(ms[0], 2)).withColumn("line", F.floor(F.col("mu") * 2 + 0.5) / 2).withColumns(R.over_line(F.col("mu"), ms[1], F.col("line"))).select(*_KEY, "mu", "line", "recommendation", "confidence", "edge"))(_context(t), R.pitch_speed()),
        f"with {_CTX}, m as (select *, round({blend_sql('pv', 92.8, 'pp', 300.0)} - 2.2 - case when strikes = 2 then 0.4 else 0.0 end + case when balls = 3 then 0.3 else 0.0 end, 2) as mu from ctx), l as (select *, floor(mu * 2 + 0.5) / 2 as line from m), o as (select *, 1 - {_cdf('((line - mu) / 5.4::double)')} as ov from l) select game_pk, at_bat_index, pitch_number, mu, line, case when ov >= 0.5 then 'over' else 'under' end as recommendation, round(greatest(ov, 1 - ov), 4) as confidence, round(greatest(ov, 1 - ov) - 0.5, 4) as edge from o",
    ),
    "r5_game_totals": (
        lambda t: R.game_totals(t.games.where(F.col("season") == SEASON), A.team_run_rates(t.games, SEASON), A.park_factors(t.games)).select("game_pk", "sample_games", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma")),
        f"""
with {_WINS}, tr as (select team_id, count(*) as n, round(avg(rs), 3) as rs, round(avg(ra), 3) as ra from s group by 1),
 sc as (select venue_id, home_score + away_score as runs from games_v), pl as (select avg(runs) as m from sc), pv as (select venue_id, count(*) as g, avg(runs) as r from sc group by 1),
 pf as (select venue_id, round(1 + (r / nullif(m, 0) - 1) * (g / (g + 200)), 4) as factor from pv cross join pl),
 j as (select g.game_pk, g.temp_f, factor, least(coalesce(h.n, 0), coalesce(a.n, 0)) as n, h.rs as hrs, h.ra as hra, a.rs as ars, a.ra as ara from games_v g left join tr h on h.team_id = home_team_id left join tr a on a.team_id = away_team_id left join pf on pf.venue_id = g.venue_id where season = {SEASON}),
 e as (select game_pk, n, temp_f, factor, ({blend_sql('hrs', 4.4, 'n', 40.0)} + {blend_sql('ara', 4.4, 'n', 40.0)}) / 2 + ({blend_sql('ars', 4.4, 'n', 40.0)} + {blend_sql('hra', 4.4, 'n', 40.0)}) / 2 as runs from j),
 m as (select game_pk, n, least(14.0, greatest(4.5, runs * case when factor is null then 1.0 else least(1.18, greatest(0.85, factor)) end * case when temp_f is null then 1.0 else least(1.08, greatest(0.94, 1 + 0.004::double * (temp_f - 70))) end)) as mu from e)
select game_pk, n as sample_games, round(mu, 6) as mu, round(greatest(3.0, sqrt(2 * mu)), 6) as sigma from m""",
    ),
    "r15_pending_positions": (
        lambda t: R.pending_positions(t.pitches, t.predictions.where("market = 'pitch_result'"), t.pitches.groupBy("game_pk").agg((F.max("at_bat_index") + 1).alias("at_bat_index")).where("game_pk % 3 = 0"), 2),
        """
with o as (select game_pk, max(at_bat_index) + 1 as at_bat_index from pitches_v where game_pk % 3 = 0 group by 1),
 th as (select game_pk, at_bat_index, count(*) - 1 as last, false as open from pitches_v group by 1, 2 union all select game_pk, at_bat_index, 0, true from o),
 nw as (select *, max(at_bat_index) over (partition by game_pk) as newest from th), w as (select game_pk, at_bat_index, open, unnest(range(0, last + 1)) as k from nw where at_bat_index > newest - 2)
select w.game_pk, w.at_bat_index, cast(w.k as int) as pitch_number, w.open from w where not exists (select 1 from predictions_v p where p.market = 'pitch_result' and p.game_pk = w.game_pk and p.at_bat_index = w.at_bat_index and p.pitch_number = w.k)""",
    ),
    "n1_flatten_pitches": (
        lambda t: N.flatten_pitches(N.to_feed(t.pitches, t.at_bats)).select("game_pk", "at_bat_index", "pitch_number", "pitcher_id", "balls", "strikes", "home_score", "men_on_base", "pitch_of_game", "times_through_order", "description", "result_category", "start_speed", "zone", "inning"),
        """
with a as (select *, 1 + at_bat_index // 2 as inn, case when (game_pk + at_bat_index) % 5 <> 0 then at_bat_index + 1 end as sc from at_bats_v),
 b as (select *, coalesce(last_value(sc ignore nulls) over (partition by game_pk order by at_bat_index rows between unbounded preceding and 1 preceding), 0) as pre,
  case when lag(inn) over g = inn then coalesce(lag(men_on_base) over g, 'Empty') else 'Empty' end as men, row_number() over (partition by game_pk, pitcher_id, batter_id order by at_bat_index) as tto from a window g as (partition by game_pk order by at_bat_index))
select p.game_pk, p.at_bat_index, p.pitch_number, p.pitcher_id, coalesce(lag(p.balls) over w, 0) as balls, coalesce(lag(p.strikes) over w, 0) as strikes, b.pre as home_score, b.men as men_on_base,
 row_number() over (partition by p.game_pk, p.pitcher_id order by p.at_bat_index, p.pitch_number) as pitch_of_game, b.tto as times_through_order, p.description, p.result_category, p.start_speed, p.zone, cast(b.inn as int) as inning
from pitches_v p join b on b.game_pk = p.game_pk and b.at_bat_index = p.at_bat_index window w as (partition by p.game_pk, p.at_bat_index order by p.pitch_number)""",
    ),
    "n2_flatten_at_bats": (
        lambda t: N.flatten_at_bats(N.to_feed(t.pitches, t.at_bats)).select("game_pk", "at_bat_index", "pitcher_id", "batter_id", "pitch_count", "result", "result_detail"),
        "select game_pk, at_bat_index, pitcher_id, batter_id, pitch_count, result, result_detail from at_bats_v",
    ),
    "f26_json_access": (
        lambda t: t.base("events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")),
        "select event_id, cast(json_extract_string(props, '$.k') as int) as k from events",
    ),
    "f15_eastern_day": (
        lambda t: t.base("events").groupBy(P.eastern_day(F.col("ts").cast("timestamp")).alias("day")).agg(F.count("*").alias("n")),
        "select cast(timezone('America/New_York', timezone('UTC', ts)) as date) as day, count(*) as n from events group by 1",
    ),
    "v15_pitch_mix": (
        lambda t: A.first_per_key(t.pitches.where("pitch_type is not null").groupBy("pitcher_id", "pitch_type").agg(F.count("*").alias("n")).join(t.pitches.where("pitch_type is not null").groupBy("pitcher_id").agg(F.count("*").alias("total")), "pitcher_id").withColumn("share", F.round(F.col("n") / F.col("total"), 6)), ["pitcher_id", "pitch_type"], [F.col("n")]),
        "select pitcher_id, pitch_type, count(*) as n, sum(count(*)) over (partition by pitcher_id) as total, round(count(*) / sum(count(*)) over (partition by pitcher_id), 6) as share from pitches_v where pitch_type is not null group by 1, 2",
    ),
}
