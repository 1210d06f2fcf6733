"""Queries over boards, picks, model runs and ingest quality, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import aggregates as A
from fungo.operators import boards as B
from fungo.operators import features as X
from fungo.operators import grading as G
from fungo.operators import models as M
from fungo.operators import pricing as R
from fungo.operators import quality as Q
from fungo.sources import datasets as D
from fungo.sources import feeds as S

DAY = "1998-07-15"

#: The last three seasons that are there, by the rule of the built player tables.
_WINDOW = f"span as (select cast(min(s) as int) as first_season from (select distinct year(game_date) as s from pitches_v order by s desc limit {A.WINDOW_SEASONS}))"

#: Quotes that name both teams, one team, or a team that does not play, and pitches under the names of tracking files.
_TEAM_QUOTES = """select game_pk * 10 as quote_id, game_date, case when game_pk % 3 = 1 then null when game_pk % 5 = 0 then 999 else away_team_id end as away_team_id,
 case when game_pk % 3 = 2 and game_pk % 2 = 0 then null else home_team_id end as home_team_id from games_v"""
_VERIFIED = "select dataset, day, rows_n, games, case when day(day) % 4 <> 0 then day end as verified_at from ledger_v where dataset = 'games'"
_TRACKED = """select game_pk, at_bat_index as at_bat_number, pitch_number, pitcher_id as pitcher, batter_id as batter, pitch_type, start_speed as release_speed, cast(zone as varchar(9)) as zone, description, balls, strikes, outs as outs_when_up, inning,
 case when top_inning then 'Top' else 'Bot' end as inning_topbot, game_date from pitches_v"""

#: A total for each game and quotes of it by two sources, drawn from the derived tables.
_TOTALS = "select game_pk, 'game_total' as market, cast(home_team_id % 7 + away_team_id % 6 as double) as predicted_value, 0.5::double + (game_pk % 40) / 100 as confidence from games_v where game_pk % 8 <> 3"
_PRICE_P = "case when {p} < 0 then -{p} / (100.0 - {p}) else 100.0 / (100 + {p}) end"
_QUOTED = f"""select game_pk, 'game_total' as market, source, case outcome when 'home' then 'over' else 'under' end as outcome, case when game_pk % 9 <> 0 then 4.5::double + (game_pk + length(source)) % 4 end as line, price_american,
 case when game_pk % 7 <> 0 then {_PRICE_P.format(p='price_american')} end as implied_prob from odds_v where id % 2 = 0"""
_PHASED = "select id, game_pk, market, recommendation, confidence, case when pitch_number = 0 then 'pregame' when model_version = 'v1' then 'replay' else 'live' end as phase from predictions_v where at_bat_index = 0"


def _totals(t):
    value = (F.col("home_team_id") % 7 + F.col("away_team_id") % 6).cast("double")
    return t.games.where("game_pk % 8 <> 3").select("game_pk", F.lit("game_total").alias("market"), value.alias("predicted_value"), (F.lit(0.5) + (F.col("game_pk") % 40) / 100).alias("confidence"))


def _quoted(t):
    line = F.when(F.col("game_pk") % 9 != 0, F.lit(4.5) + (F.col("game_pk") + F.length("source")) % 4)
    raw = t.odds.where("id % 2 = 0").select("game_pk", F.lit("game_total").alias("market"), "source", F.when(F.col("outcome") == "home", "over").otherwise("under").alias("outcome"), line.alias("line"), "price_american", F.lit(None).cast("double").alias("implied_prob"))
    return B.full_quote(raw).withColumn("implied_prob", F.when(F.col("game_pk") % 7 != 0, F.col("implied_prob")))


def _two_sided(t):
    q = _quoted(t).where("source = 'espn'")
    side = lambda o: F.max(F.when(F.col("outcome") == o, F.col("price_american"))).alias(f"{o}_price")
    return q.groupBy("game_pk", "market").agg(F.max("line").alias("line"), side("over"), side("under"))


def _phased(t):
    phase = F.when(F.col("pitch_number") == 0, "pregame").when(F.col("model_version") == "v1", "replay").otherwise("live")
    return t.predictions.where("at_bat_index = 0").select("id", "game_pk", "market", "recommendation", "confidence", phase.alias("phase"))


def _pick_parts(t):
    base = t.predictions.select(F.col("created_date").alias("pick_date"), "game_pk", "market", "at_bat_index", "recommendation", F.col("price").cast("int").alias("price"), "confidence", F.round(F.col("confidence") - 0.45, 4).alias("edge"), F.col("pitch_number").alias("pitch_count_pa"))
    lines = base.where("market = 'pitch_speed_ou'")
    results = base.where("market = 'pitch_result'").withColumn("recommendation", F.when(F.col("recommendation") == "ball", "walk").when(F.col("recommendation") == "in_play", "hit").otherwise("out"))
    return lines.where("game_pk % 2 = 0"), results, lines.where("game_pk % 2 = 1")


_PICKS = """
 offered as (select created_date as pick_date, game_pk, market, at_bat_index, recommendation as side, price, confidence, round(confidence - 0.45, 4) as edge, pitch_number as thrown from predictions_v),
 taken as (select pick_date, game_pk, market, at_bat_index, side as recommendation, cast(price as int) as price, confidence, edge, thrown from offered where market = 'pitch_speed_ou' and game_pk % 2 = 0 and edge >= 0.04
  union all select pick_date, game_pk, market, at_bat_index, case side when 'ball' then 'walk' else 'hit' end, null, confidence, round(confidence - 0.5, 4), thrown from offered where market = 'pitch_result' and side in ('ball', 'in_play') and confidence >= 0.52 and thrown <= 1
  union all select pick_date, game_pk, market, at_bat_index, side, 100, confidence, edge, thrown from offered where market = 'pitch_speed_ou' and game_pk % 2 = 1 and confidence >= 0.58),
 picked as (select pick_date, game_pk, market, at_bat_index, recommendation, price, confidence, edge from taken qualify row_number() over (partition by pick_date, game_pk, market, at_bat_index, recommendation order by thrown, confidence desc) = 1)"""


def _ledger(t):
    return t.ledger.withColumns({"bytes": F.col("rows_n") * F.when(F.dayofyear("day") % 53 == 0, 140).otherwise(70) + F.col("games"), "ingested_at": F.col("day").cast("timestamp") + F.make_dt_interval(F.lit(1), (F.col("rows_n") % 50).cast("int"))})


_LEDGER = "select *, rows_n * case when dayofyear(day) % 53 = 0 then 140 else 70 end + games as bytes, day::timestamp + interval 1 day + to_hours(cast(rows_n % 50 as int)) as ingested_at from ledger_v"

_SCORED_SQL = f"""with l as ({_LEDGER}), f as (select *, round(rows_n / games, 6) as rpg, round(bytes / rows_n, 6) as bpr, round(date_diff('second', day::timestamp, ingested_at) / 86400, 6) as lag,
  count(*) over (partition by dataset, cast(ingested_at as date)) > 20 as bulk, row_number() over (partition by dataset order by day desc) as newest from l),
 long as (select dataset, day, 'rpg' as metric, rpg as v, 5.0 as floor_pct, games >= 3 as judged from f union all select dataset, day, 'bpr', bpr, 15.0, rows_n >= 3000 from f),
 past as (select *, list(v) over (partition by dataset, metric order by day rows between 28 preceding and 1 preceding) as prior from long),
 mid as (select *, case when len(prior) >= 10 then list_median(prior) end as med from past),
 dev as (select *, case when med is not null then list_median(list_transform(prior, lambda y: abs(y - med))) end as mad from mid),
 moved as (select *, abs(100.0 * (v - med) / nullif(med, 0)) as rel, case when mad > 0 then abs(0.6745 * (v - med) / mad) end as z from dev),
 told as (select *, case when not judged or rel is null or rel <= floor_pct then 0 when z is null then case when rel > 3 * floor_pct then 2 else 1 end when z > 3.5 then 2 when z > 2.5 then 1 else 0 end as grade from moved),
 wide as (select dataset, day, max(med) filter (where metric = 'rpg') as med, max(grade) filter (where metric = 'rpg') as a, max(grade) filter (where metric = 'bpr') as b from told group by 1, 2),
 all_ as (select f.dataset, f.day, round(med * games, 3) as expected_rows, a, b, case when newest > 14 or bulk then 0 when lag > 5 then 2 when lag > 3 then 1 else 0 end as c from f join wide using (dataset, day))
select dataset, day, expected_rows, ['pass', 'warn', 'fail'][a + 1] as rows_per_game_status, ['pass', 'warn', 'fail'][b + 1] as bytes_per_row_status, ['pass', 'warn', 'fail'][c + 1] as lag_days_status, ['pass', 'warn', 'fail'][greatest(a, b, c) + 1] as status from all_"""


def _windowed(games):
    return games.withColumn("start_ts", F.col("game_date").cast("timestamp") + F.make_dt_interval(hours=(F.col("game_pk") % 24).cast("int")))


def _remaining(t):
    table = M.remaining_table(X.remaining_pitch_cells(t.pitches, t.at_bats)).select("balls", "strikes", F.col("mean").alias("remaining_mean"))
    # at most twelve counts
    ctx = t.pitches.select("game_pk", "at_bat_index", "pitch_number", "balls", "strikes", (F.col("pitch_number") - 1).alias("pitch_count_pa")).join(F.broadcast(table), ["balls", "strikes"], "left")
    return ctx.select("game_pk", "at_bat_index", "pitch_number", F.round(R.pa_pitches(table), 2).alias("expected_pitches"))


_LEFT = """
 states as (select p.balls, p.strikes, least(a.pitch_count - p.pitch_number + 1, 12) as remaining from at_bats_v a join pitches_v p using (game_pk, at_bat_index) where a.pitch_count between 1 and 30 and p.pitch_number <= a.pitch_count and p.balls between 0 and 3 and p.strikes between 0 and 2)"""

_FOLDS = """
 cells as (select season, home_score > away_score as home, count(*) as n from games_v where home_score <> away_score group by all),
 trials as (select distinct season as fold, h.half_life from cells cross join (select unnest([null, 1.0, 2.0]) as half_life) h where season >= 1994),
 fits as (select fold, half_life, round(sum(case when home then w else 0 end) / sum(w), 6) as home_adv from (select fold, half_life, home, n * case when half_life is null then 1.0::double else pow(0.5::double, (fold - 1 - season) / half_life) end as w from trials join cells on season < fold) group by all),
 folds as (select fold, f.half_life, home_adv, round(sum(-n * ln(case when home then home_adv else 1 - home_adv end)) / sum(n), 6) as logloss, round(sum(n * pow(1 - case when home then home_adv else 1 - home_adv end, 2)) / sum(n), 6) as brier, cast(sum(n) as bigint) as n
  from fits f join cells on season = fold group by all)"""


def _folds(t):
    return M.home_advantage_folds(X.moneyline_cells(t.games), [None, 1.0, 2.0], 1994)


_SCORES = {"in_play": 0.193, "ball": 0.352, "strike_foul": 0.455}


def _scored_cells(t):
    return X.pitch_result_cells(t.pitches).withColumns({f"p_{c}": F.lit(p) for c, p in _SCORES.items()})


PLANS = {
    "r9_line_rows": (
        lambda t: B.line_rows(_totals(t), _two_sided(t), ["game_pk", "market"]),
        f"""with called as ({_TOTALS}), quoted as ({_QUOTED}),
 two as (select game_pk, market, max(line) as line, max(case when outcome = 'over' then price_american end) as over_price, max(case when outcome = 'under' then price_american end) as under_price from quoted where source = 'espn' group by all),
 sided as (select c.*, line, case when predicted_value > line then over_price when line is not null then under_price end as price from called c left join two using (game_pk, market))
select game_pk, market, predicted_value, confidence, case when predicted_value > line then 'over' when line is not null then 'under' end as recommendation, line, price, round(confidence - {_PRICE_P.format(p='price')}, 4) as edge from sided""",
    ),
    "r9_class_rows": (
        lambda t: B.class_rows(t.pitches.select("game_pk", "at_bat_index", "pitch_number", F.create_map(F.lit("ball"), (F.col("balls") % 3) / 10.0, F.lit("in_play"), (F.col("strikes") % 2) / 10.0, F.lit("strike_foul"), F.lit(0.1)).alias("probs"))).drop("probs"),
        "with p as (select game_pk, at_bat_index, pitch_number, (balls % 3) / 10.0 as b, (strikes % 2) / 10.0 as i from pitches_v) select game_pk, at_bat_index, pitch_number, case when b >= greatest(i, 0.1) then 'ball' when i >= 0.1 then 'in_play' else 'strike_foul' end as recommendation, greatest(b, i, 0.1) as predicted_value from p",
    ),
    "r10_source_board": (
        lambda t: B.best_sources(_totals(t), _quoted(t), ["game_pk", "market"]),
        f"""with called as ({_TOTALS}), quoted as ({_QUOTED}),
 priced as (select c.game_pk, q.source, q.outcome, q.line, q.price_american, round(confidence - implied_prob, 4) as edge from called c join quoted q on q.game_pk = c.game_pk and q.outcome = case when predicted_value > q.line then 'over' when q.line is not null then 'under' end where implied_prob is not null),
 ranked as (select *, count(*) over (partition by game_pk) as sources, row_number() over (partition by game_pk order by edge desc, source desc) as k from priced)
select c.*, outcome as recommendation, line, price_american as price, edge, source as best_source, coalesce(sources, 0) as sources from called c left join ranked r on r.game_pk = c.game_pk and k = 1""",
    ),
    "r10_external_rows": (
        lambda t: B.external_rows(_quoted(t), _totals(t), ["game_pk", "market"]).select("game_pk", "source", "outcome", "price_american", "edge"),
        f"with called as ({_TOTALS}), quoted as ({_QUOTED}) select game_pk, source, outcome, price_american, null::double as edge from quoted q where not exists (select 1 from called c where c.game_pk = q.game_pk)",
    ),
    "r14_live_picks": (lambda t: B.live_picks(*_pick_parts(t)), f"with {_PICKS} select * from picked"),
    "o5_picks_of_day": (
        lambda t: B.picks_of_day(B.live_picks(*_pick_parts(t)), F.lit(DAY).cast("date")),
        f"with {_PICKS} select * from picked where pick_date = date '{DAY}' order by edge desc nulls last, game_pk, recommendation limit 50",
    ),
    "w11_preferred_phase": (
        lambda t: B.preferred(_phased(t), ["game_pk", "market"], "phase", ["live", "pregame"], "id"),
        f"with phased as ({_PHASED}) select game_pk, market, id, recommendation, confidence, phase from phased qualify row_number() over (partition by game_pk, market order by case phase when 'live' then 1 when 'pregame' then 2 else 3 end, id desc) = 1",
    ),
    "v3_slate": (
        lambda t: B.slate(t.games, F.lit(DAY).cast("date"), t.predictions).select("game_pk", "home_team_id", "away_team_id", "status", "calls", "markets", "top_confidence"),
        f"select g.game_pk, home_team_id, away_team_id, status, count(p.id) as calls, count(distinct p.market) as markets, max(p.confidence) as top_confidence from games_v g left join predictions_v p on p.game_pk = g.game_pk where g.game_date = date '{DAY}' group by 1, 2, 3, 4",
    ),
    "v11_games_of_day": (
        lambda t: t.games.where(F.col("game_date") == F.lit(DAY).cast("date")).select("game_pk", "home_team_id", "away_team_id", "home_score", "away_score", "status"),
        f"select game_pk, home_team_id, away_team_id, home_score, away_score, status from games_v where game_date = date '{DAY}'",
    ),
    "f30_full_quotes": (
        lambda t: B.full_quote(t.odds.select("id", F.when(F.col("id") % 3 > 0, F.col("price_american")).alias("price_american"), F.when(F.col("id") % 3 < 2, F.lit(0.25) + (F.col("id") % 5) / 10).alias("implied_prob"))).select("id", F.col("price_american").cast("int").alias("price_american"), F.round("implied_prob", 8).alias("implied_prob")),
        f"""with cut as (select id, case when id % 3 > 0 then price_american end as a, case when id % 3 < 2 then 0.25::double + (id % 5) / 10 end as p from odds_v)
select id, cast(coalesce(a, case when p >= 0.5 then round(-100 * p / (1 - p)) else round(100 * (1 - p) / p) end) as int) as price_american, round(coalesce(p, {_PRICE_P.format(p='a')}), 8) as implied_prob from cut""",
    ),
    "p5_games_in_window": (
        lambda t: B.in_window(_windowed(t.games), F.lit(f"{DAY} 18:00:00").cast("timestamp"), t.games.where("status = 'In Progress'")).select("game_pk", "is_live"),
        f"with started as (select *, game_date::timestamp + to_hours(cast(game_pk % 24 as int)) as start_ts from games_v) select game_pk, status = 'In Progress' as is_live from started where status = 'In Progress' or timestamp '{DAY} 18:00:00' between start_ts and start_ts + interval 239 minute + interval 59 second",
    ),
    "k4_observed_calls": (
        lambda t: B.observed(G.call_pairs(t.predictions), t.pitches).select("game_pk", "at_bat_index", "pitch_number", "class_right", "speed_right"),
        """with pairs as (select game_pk, at_bat_index, pitch_number, max(recommendation) filter (where market = 'pitch_result') as class, max(recommendation) filter (where market = 'pitch_speed_ou') as side, max(line) as line from predictions_v group by all)
select c.game_pk, c.at_bat_index, c.pitch_number, class = result_category as class_right, side = case when start_speed > line then 'over' when start_speed <= line then 'under' end as speed_right
from pairs c left join pitches_v p on p.game_pk = c.game_pk and p.at_bat_index = c.at_bat_index and p.pitch_number = c.pitch_number + 1""",
    ),
    "n12_at_bats_of_pitches": (
        lambda t: A.at_bats_of_pitches(t.pitches.join(t.at_bats.select("game_pk", "at_bat_index", "pitch_count", "result_detail"), ["game_pk", "at_bat_index"]).withColumn("events", F.when(F.col("pitch_number") == F.col("pitch_count"), F.col("result_detail")))).select("game_pk", "at_bat_index", "pitcher_id", "batter_id", "pitch_count", "result", "result_detail"),
        "select game_pk, at_bat_index, pitcher_id, batter_id, cast(pitch_count as bigint) as pitch_count, case when result_detail in ('single', 'double', 'triple', 'home_run') then 'hit' when result_detail = 'strikeout' then 'strikeout' when result_detail = 'walk' then 'walk' else 'out' end as result, result_detail from at_bats_v",
    ),
    "r4_remaining_pitches": (
        _remaining,
        f"""with {_LEFT}, means as (select balls, strikes, round(avg(remaining), 6) as mean from states group by all)
select game_pk, at_bat_index, pitch_number, round(coalesce(pitch_number - 1 + mean, greatest(pitch_number, 3.85)), 2) as expected_pitches from pitches_v p left join means m on m.balls = p.balls and m.strikes = p.strikes""",
    ),
    "m11_remaining_table": (
        lambda t: M.remaining_table(X.remaining_pitch_cells(t.pitches, t.at_bats)).select("balls", "strikes", "mean", F.explode("dist").alias("remaining", "share")),
        f"with {_LEFT} select balls, strikes, round(sum(remaining * count(*)) over c / sum(count(*)) over c, 6) as mean, remaining, round(count(*) / sum(count(*)) over c, 6) as share from states group by balls, strikes, remaining window c as (partition by balls, strikes)",
    ),
    "m7_decayed_weights": (
        lambda t: M.decayed(X.moneyline_cells(t.games), 1998, 2.0).select("season", "home_win", F.round("weight", 6).alias("weight")),
        "select season, home_win, round(n * pow(0.5::double, (1998 - season) / 2.0), 6) as weight from (select season, cast(home_score > away_score as int) as home_win, count(*) as n from games_v where home_score <> away_score group by all)",
    ),
    "m12_home_advantage": (
        lambda t: M.home_advantage(X.moneyline_cells(t.games), 2.0, 1998),
        "select round(sum(case when home_score > away_score then pow(0.5::double, (1998 - season) / 2.0) else 0 end) / sum(pow(0.5::double, (1998 - season) / 2.0)), 6) as home_adv from games_v where home_score <> away_score",
    ),
    "m15_class_metrics": (
        lambda t: M.class_metrics(_scored_cells(t), list(_SCORES)),
        f"""with told as (select case when is_in_play then 'in_play' when is_ball then 'ball' else 'strike_foul' end as outcome from pitches_v p where exists (select 1 from pitches_v q where q.pitcher_id = p.pitcher_id and q.game_date < p.game_date))
select round(avg(-ln(case outcome {' '.join(f"when '{c}' then {p}::double" for c, p in _SCORES.items())} end)), 6) as logloss, round(avg({' + '.join(f"pow({p}::double - cast(outcome = '{c}' as int), 2)" for c, p in _SCORES.items())}), 6) as brier, count(*) as n from told""",
    ),
    "m16_row_coverage": (
        lambda t: M.row_coverage(t.pitches, F.col("start_speed"), F.lit(R.LEAGUE_SPEED), R.SPEED_SIGMA),
        f"select round(avg(cast(abs(start_speed - {R.LEAGUE_SPEED}::double) <= {R.SPEED_SIGMA}::double as int)), 6) as coverage, count(*) as n from pitches_v where start_speed is not null",
    ),
    "m17_calibration": (
        lambda t: M.calibration(t.predictions.withColumn("n", F.lit(1)), "confidence", F.col("game_pk") % 3 == 0),
        "select cast(least(9, floor(confidence * 10)) as int) as bin, round(avg(confidence), 6) as mean_prob, round(avg(cast(game_pk % 3 = 0 as int)), 6) as hit_rate, cast(count(*) as bigint) as n from predictions_v group by 1",
    ),
    "m19_home_advantage_folds": (_folds, f"with {_FOLDS} select fold, half_life, home_adv, logloss, brier, n from folds"),
    "m20_best_half_life": (
        lambda t: M.best_setting(M.sweep(_folds(t), ["half_life"], ["logloss", "brier"]), "logloss").select("half_life", "logloss", "brier", "folds_used", "n"),
        f"with {_FOLDS} select half_life, round(sum(logloss * n) / sum(n), 6) as logloss, round(sum(brier * n) / sum(n), 6) as brier, count(*) as folds_used, cast(sum(n) as bigint) as n from folds group by half_life order by 2, half_life nulls first limit 1",
    ),
    "m25_version_drift": (
        lambda t: M.version_drift(t.predictions.select("market", F.lit("v2").alias("version"), F.lit(True).alias("is_active")).distinct(), t.predictions),
        "select market, 'v2' as active_version, arg_max(model_version, {'d': created_date, 'i': id}) as stamped_version, arg_max(model_version, {'d': created_date, 'i': id}) <> 'v2' as drifted from predictions_v group by market",
    ),
    "q2_missingness": (
        lambda t: Q.missingness(t.pitches, ["zone", "start_speed", "pitch_type", "launch_speed", "balls"], ["launch_speed"]),
        """with counted as (select count(*) as n, unnest([{'column': 'zone', 'present': count(zone)}, {'column': 'start_speed', 'present': count(start_speed)}, {'column': 'pitch_type', 'present': count(pitch_type)}, {'column': 'launch_speed', 'present': count(launch_speed)}, {'column': 'balls', 'present': count(balls)}], recursive := true) from pitches_v)
select "column", n - present as missing, round(100.0 * (n - present) / n, 6) as missing_pct, present, "column" = 'launch_speed' as structural, case when "column" = 'launch_speed' or 100.0 * (n - present) / n <= 1 then 'ok' when 100.0 * (n - present) / n > 5 then 'alert' else 'warn' end as severity from counted""",
    ),
    "q11_ingest_frame": (
        lambda t: Q.ingest_frame(_ledger(t)),
        f"""with l as ({_LEDGER}), b as (select *, count(*) over (partition by dataset, cast(ingested_at as date)) as batch_files from l)
select dataset, day, rows_n, games, bytes, round(rows_n / games, 6) as rows_per_game, round(bytes / rows_n, 6) as bytes_per_row, round(date_diff('second', day::timestamp, ingested_at) / 86400, 6) as lag_days, batch_files, batch_files > 20 as from_backfill from b""",
    ),
    "q12_scored_days": (
        lambda t: Q.scored_days(Q.ingest_frame(_ledger(t))).select("dataset", "day", "expected_rows", "rows_per_game_status", "bytes_per_row_status", "lag_days_status", "status"),
        _SCORED_SQL,
    ),
    "j15_quoted_games": (
        lambda t: B.quoted_games(t.sql(_TEAM_QUOTES), t.games),
        f"""with q as ({_TEAM_QUOTES}), side as (select game_date, home_team_id as team, game_pk from games_v union all select game_date, away_team_id, game_pk from games_v),
 m as (select q.*, (select max(g.game_pk) from games_v g where g.game_date = q.game_date and g.away_team_id = q.away_team_id and g.home_team_id = q.home_team_id) as p,
  case when q.home_team_id is null or q.away_team_id is null then (select max(s.game_pk) from side s where s.game_date = q.game_date and s.team = coalesce(q.home_team_id, q.away_team_id)) end as s from q)
select quote_id, game_date, away_team_id, home_team_id, coalesce(p, s) as game_pk, case when p is not null then 'pair' when s is not null then 'team' end as matched_by from m""",
    ),
    "s22_tracking_rows": (
        lambda t: S.tracking_rows(t.sql(_TRACKED)).drop("pitch_ts"),
        f"""with r as ({_TRACKED}) select game_pk, cast(at_bat_number as bigint) as at_bat_index, cast(pitch_number as bigint) as pitch_number, cast(pitcher as bigint) as pitcher_id, cast(batter as bigint) as batter_id,
 try_cast(zone as bigint) as zone, cast(balls as bigint) as balls, cast(strikes as bigint) as strikes, cast(outs_when_up as bigint) as outs, cast(inning as bigint) as inning, pitch_type,
 cast(release_speed as double) as start_speed, description, inning_topbot = 'Top' as top_inning, case description when 'ball' then 'ball' when 'in_play' then 'in_play' else 'strike_foul' end as result_category from r where release_speed is not null""",
    ),
    "s21_hot_window": (
        lambda t: D.hot_window(t.games.select("game_pk", "game_date"), t.sql(_VERIFIED), "game_date", F.lit(DAY).cast("date")),
        f"with l as ({_VERIFIED}) select game_pk, game_date from games_v where game_date >= date '{DAY}' - 35 or game_date not in (select day from l where verified_at is not null)",
    ),
    "s23_ledger_of_old": (
        lambda t: D.ledger_of_old(t.sql(_VERIFIED).withColumn("games", F.when(F.col("games") > 3, F.col("games")))).select("dataset", "day", "rows_n", "games", "ingested_at", F.col("verified_at").isNull().alias("unverified")),
        f"select dataset, day, rows_n, case when games > 3 then games else 0 end as games, cast(verified_at as timestamp) as ingested_at, true as unverified from ({_VERIFIED})",
    ),
    "j14_named_at_bats": (
        lambda t: A.with_names(t.at_bats, t.base("supplier").select(F.col("s_suppkey").cast("int").alias("player_id"), F.col("s_name").alias("full_name"))).select("game_pk", "at_bat_index", "pitcher_name", "batter_name", "result"),
        "select a.game_pk, a.at_bat_index, p.s_name as pitcher_name, b.s_name as batter_name, a.result from at_bats_v a left join supplier p on p.s_suppkey = a.pitcher_id left join supplier b on b.s_suppkey = a.batter_id",
    ),
    "o6_sampled_days": (
        lambda t: Q.sampled_days(t.ledger, 20, 7).select("dataset", "day"),
        "select dataset, day from ledger_v order by md5('7:' || dataset || ':' || cast(day as varchar)), dataset, day limit 20",
    ),
    "q19_newest_rows": (
        lambda t: Q.newest_rows(t.games, [F.desc("game_date"), F.desc("game_pk")], ["game_pk", "game_date", "status"]),
        "select game_pk, game_date, status from games_v order by game_date desc, game_pk desc limit 20",
    ),
    "a8_built_matchups": (
        lambda t: A.build("matchup_history", t.pitches, t.at_bats, t.games).select("pitcher_id", "batter_id", "season_floor", "pa_count"),
        f"with {_WINDOW} select pitcher_id, batter_id, first_season as season_floor, count(*) as pa_count from at_bats_v join span on year(game_date) >= first_season group by all having count(*) >= {A.MIN_MEETINGS}",
    ),
    "a8_built_fatigue": (
        lambda t: A.build("pitcher_fatigue_profile", t.pitches, t.at_bats, t.games).select("pitcher_id", "pitch_bucket", "season_floor", "n"),
        f"with {_WINDOW} select pitcher_id, cast(least(pitch_of_game // 25, 4) as int) as pitch_bucket, first_season as season_floor, count(*) as n from pitches_v join span on year(game_date) >= first_season group by all",
    ),
    "a8_built_power": (
        lambda t: A.build("batter_power_profile", t.pitches, t.at_bats, t.games).select("batter_id", "scope", "season_floor", "pa", "hr"),
        f"""with {_WINDOW}, seen as (select * from at_bats_v join span on year(game_date) >= first_season), last as (select max(game_date) as d from seen),
 scopes as (select 'career' as scope, * from seen union all select 'season', s.* from seen s join last on year(game_date) = year(d) union all select 'd30', s.* from seen s join last on date_diff('day', game_date, d) < {A.RECENT_DAYS})
select batter_id, scope, cast(greatest(first_season, {A.TRACKED_SINCE}) as int) as season_floor, count(*) as pa, cast(sum(cast(result_detail = 'home_run' as int)) as bigint) as hr from scopes group by all having count(*) >= {A.MIN_PA}""",
    ),
    "a8_built_context": (
        lambda t: A.build("game_context", t.pitches, t.at_bats, t.games).select("game_pk", "game_date", "season", "venue_id", "season_floor"),
        "select game_pk, game_date, season, venue_id, (select cast(min(year(game_date)) as int) from pitches_v) as season_floor from games_v",
    ),
}
