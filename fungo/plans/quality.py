"""Data-quality queries, with the same answers in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from fungo.operators import quality as Q

CUT = "1998-01-01"
_NULLABLE = ["start_speed", "zone", "pitch_type", "launch_speed", "launch_angle"]
_METRICS = ["start_speed", "launch_speed", "launch_angle"]
_CATEGORIES = ["pitch_type", "result_category", "men_on_base"]
_L = f"game_date >= date '{CUT}'"


def _latest():
    return F.col("game_date") >= F.lit(CUT).cast("date")


_NULLS = " union all ".join(f"select '{c}' as \"column\", count(*) filter (where {_L}) as latest_rows, count(*) filter (where {_L} and {c} is null) as latest_missing, count(*) filter (where not {_L}) as baseline_rows, count(*) filter (where not {_L} and {c} is null) as baseline_missing from pitches_v" for c in _NULLABLE)
#: Columns of the derived tables that rules speak of.
_COLUMNS = {
    "pitches": ["game_pk", "at_bat_index", "pitch_number", "game_date", "pitch_ts", "balls", "strikes", "outs", "inning", "start_speed", "launch_speed"],
    "at_bats": ["game_pk", "at_bat_index", "pitch_count"],
    "games": ["game_pk", "game_date", "season", "home_score", "away_score", "temp_f"],
}


def _violations_sql(dataset: str) -> str:
    def one(name: str, rule: str) -> str:
        label = name.replace("'", "''")
        counts = ", ".join(f"count(*) filter (where {p} and ({rule})) as {n}" for n, p in (("latest", _L), ("baseline", f"not {_L}")))
        return f"select '{label}' as rule, {counts}, count(*) filter (where {_L}) as latest_rows, count(*) filter (where not {_L}) as baseline_rows from {dataset}_v"

    return " union all ".join(one(n, r) for n, r in Q.rules_of(dataset, _COLUMNS[dataset]).items())


def _violations(t, dataset="pitches"):
    return Q.violations(getattr(t, dataset), Q.rules_of(dataset, _COLUMNS[dataset]), _latest())


_VIOLATIONS = _violations_sql("pitches")


def _rated(violations: str) -> str:
    rate = lambda p: f"round(100.0 * {p} / {p}_rows, 6) as {p}_rate"
    status = f"case when latest = 0 then 'pass' when baseline = 0 then 'fail' when baseline_rate is null then 'warn' when abs(latest_rate - baseline_rate) > {Q.RATE_MOVE_POINTS} then 'warn' else 'known' end as status"
    return f"with v as ({violations}), r as (select *, {rate('latest')}, {rate('baseline')} from v) select *, {status} from r"


def _stats_sql(where: str) -> str:
    q = lambda c, p: f"quantile_cont({c}::double, {p})"
    return " union all ".join(f"select '{c}' as metric, round({q(c, 0.05)}, 6) as p05, round({q(c, 0.5)}, 6) as median, round({q(c, 0.95)}, 6) as p95, round(({q(c, 0.75)} - {q(c, 0.25)}) / 1.349, 6) as spread, round(100.0 * (count(*) - count({c})) / count(*), 6) as null_pct from pitches_v where {where}" for c in _METRICS)


_DAILY = "select 'pitches' as dataset, game_date as day, count(*) as rows_n, count(distinct game_pk) as games from pitches_v group by game_date"
_BASELINE = f"""
w as (select *, list(rows_n::double) over (order by day rows between 28 preceding and 1 preceding) as past from ({_DAILY})),
m as (select *, case when len(past) >= 10 then list_median(past) end as med from (select *, past from w)),
d as (select *, case when med is not null then list_median(list_transform(past, lambda x: abs(x - med))) end as mad from m),
s as (select *, 100.0 * (rows_n - med) / nullif(med, 0) as rel, case when mad > 0 then 0.6745 * (rows_n - med) / mad end as z from d)"""
_SEVERITY = "case when rel is null or not abs(rel) > 5.0 then 'pass' when z is null then case when abs(rel) > 15.0 then 'fail' else 'warn' end when abs(z) > 3.5 then 'fail' when abs(z) > 2.5 then 'warn' else 'pass' end"

PLANS = {
    "q1_null_counts": (lambda t: Q.null_counts(t.pitches, _NULLABLE, _latest()), _NULLS),
    "q3_null_movers": (
        lambda t: Q.null_movers(Q.null_counts(t.pitches, _NULLABLE, _latest())),
        f'with n as ({_NULLS}) select "column", round(100.0 * latest_missing / latest_rows, 6) as latest_pct, round(100.0 * baseline_missing / baseline_rows, 6) as baseline_pct, round(100.0 * latest_missing / latest_rows - 100.0 * baseline_missing / baseline_rows, 6) as shift_pp from n',
    ),
    "q4_duplicate_keys": (
        lambda t: Q.duplicate_keys(t.base("lineitem"), ["l_orderkey", "l_linenumber"]),
        "select sum(c) as n_rows, count(*) as n_keys, sum(c) - count(*) as surplus from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)",
    ),
    "q5_violations": (_violations, _rated(_VIOLATIONS)),
    "q5_at_bat_violations": (lambda t: _violations(t, "at_bats"), _rated(_violations_sql("at_bats"))),
    "q5_game_violations": (lambda t: _violations(t, "games"), _rated(_violations_sql("games"))),
    "q7_histograms": (
        lambda t: Q.histograms(t.pitches, Q.HISTOGRAMS, _latest()),
        "with x as (" + " union all ".join(f"select '{c}' as metric, cast(greatest(0, least({n} - 1, floor(({c} - {lo}) / {(hi - lo) / n}))) as int) as bin, {lo}::double as lo, {(hi - lo) / n}::double as step, {_L} as l from pitches_v where {c} is not null" for c, (lo, hi, n) in Q.HISTOGRAMS.items()) + ") select metric, bin, round(any_value(lo) + bin * any_value(step), 6) as bin_start, count(*) filter (where l) as latest_n, count(*) filter (where not l) as baseline_n from x group by 1, 2",
    ),
    "q8_robust_stats": (lambda t: Q.robust_stats(t.pitches, _METRICS), _stats_sql("true")),
    "q9_drift": (
        lambda t: Q.drift(Q.robust_stats(t.pitches.where(~_latest()), _METRICS), Q.robust_stats(t.pitches.where(_latest()), _METRICS)),
        f"with b as ({_stats_sql('not ' + _L)}), l as ({_stats_sql(_L)}), j as (select metric, b.median as median_base, l.median as median_latest, b.spread as sp from b full join l using (metric)), s as (select *, 100.0 * (median_latest - median_base) / nullif(median_base, 0) as rel, case when sp > 0 then (median_latest - median_base) / sp end as z from j) select metric, median_base, median_latest, round(rel, 6) as change_pct, round(z, 6) as shift_mad, {_SEVERITY} as status from s",
    ),
    "q10_category_counts": (
        lambda t: Q.category_counts(t.pitches, _CATEGORIES, _latest()),
        "select \"column\", value, count(*) filter (where l) as latest_n, count(*) filter (where not l) as baseline_n from (" + " union all ".join(f"select '{c}' as \"column\", {c} as value, {_L} as l from pitches_v where {c} is not null" for c in _CATEGORIES) + ") group by 1, 2",
    ),
    "u3_appeared_or_vanished": (
        lambda t: Q.appeared_or_vanished(Q.category_counts(t.base("events").withColumn("kind", F.concat_ws("-", "event_type", F.dayofmonth("ts"))), ["kind", "event_type"], F.dayofmonth("ts") > 20)),
        "with e as (select concat_ws('-', event_type, day(ts)) as kind, event_type, day(ts) > 20 as l from events), x as (select \"column\", value, count(*) filter (where l) as latest_n, count(*) filter (where not l) as baseline_n from (select 'kind' as \"column\", kind as value, l from e union all select 'event_type', event_type, l from e) group by 1, 2) select *, case when baseline_n = 0 and latest_n >= 20 then 'appeared' else 'vanished' end as change from x where (baseline_n = 0 and latest_n >= 20) or (latest_n = 0 and baseline_n >= 20)",
    ),
    "w6_trailing_baseline": (
        lambda t: Q.trailing_baseline(t.ledger.where("dataset = 'pitches'"), ["dataset"], "day", "rows_n", digits=9),
        f"with {_BASELINE} select dataset, day, rows_n, games, med as rows_n_median, round(mad, 9) as rows_n_mad, round(rel, 9) as rows_n_rel_pct, round(z, 9) as rows_n_z, {_SEVERITY} as rows_n_status from s",
    ),
    "w7_day_gaps": (
        lambda t: Q.day_gaps(t.games, "game_date", ["venue_id"]),
        """with played as (select distinct venue_id, game_date as day from games_v),
 ahead as (select venue_id, day, (select min(p.day) from played p where p.venue_id = q.venue_id and p.day > q.day and year(p.day) = year(q.day)) as following from played q)
select venue_id, cast(year(day) as int) as season, day + 1 as from_day, following - 1 as to_day, cast(following - day - 1 as int) as days from ahead where following > day + 1""",
    ),
    "w8_last_rows": (
        lambda t: Q.last_rows(t.ledger, ["dataset"], [F.desc("day")], 7),
        "select * from ledger_v qualify row_number() over (partition by dataset order by day desc) <= 7",
    ),
    "w9_group_size": (
        lambda t: Q.with_group_size(t.games.select("game_pk", "game_date"), ["game_date"], above=6),
        "select game_date, game_pk, count(*) over (partition by game_date) as batch_size, count(*) over (partition by game_date) > 6 as is_backfill from games_v",
    ),
    "q13_alignment": (
        lambda t: Q.alignment(t.ledger, ["pitches", "at_bats", "games"], "pitches"),
        "with p as (select day, sum(rows_n) filter (where dataset = 'pitches') as pr, sum(rows_n) filter (where dataset = 'at_bats') as ar, sum(rows_n) filter (where dataset = 'games') as gr, sum(games) filter (where dataset = 'pitches') as pg, sum(games) filter (where dataset = 'at_bats') as ag, sum(games) filter (where dataset = 'games') as gg from ledger_v group by 1) select day, concat_ws(',', case when pr is null then 'pitches' end, case when ar is null then 'at_bats' end, case when gr is null then 'games' end) as missing, concat_ws(',', case when pg <> pg then 'pitches' end, case when ag <> pg then 'at_bats' end, case when gg <> pg then 'games' end) as game_mismatch, round(pr / ar, 6) as ratio from p",
    ),
    "j10_referential_gap": (
        lambda t: Q.referential_gap(t.pitches.select("game_pk"), t.games.where("status = 'Final'"), "game_pk"),
        "select count(*) as orphan_rows, count(distinct game_pk) as orphan_keys from pitches_v where game_pk not in (select game_pk from games_v where status = 'Final')",
    ),
    "q18_dataset_totals": (lambda t: Q.dataset_totals(t.ledger), "select dataset, count(*) as days, sum(rows_n) as total_rows, sum(games) as total_games, min(day) as first_day, max(day) as last_day from ledger_v group by 1"),
    "q17_event_freshness": (lambda t: t.base("events").groupBy("event_type").agg(F.max("ts").alias("latest_ts"), F.count("*").alias("n")), "select event_type, max(ts) as latest_ts, count(*) as n from events group by 1"),
    "q16_verdicts": (
        lambda t: Q.verdicts(
            ("violations", _violations(t), "status"),
            ("volume", Q.trailing_baseline(t.ledger.where("dataset = 'pitches'"), ["dataset"], "day", "rows_n"), "rows_n_status"),
            ("nulls", Q.moved_nulls(Q.null_movers(Q.null_counts(t.pitches, _NULLABLE, _latest())), structural=["launch_angle"]), "status"),
            ("drift", Q.drift(Q.robust_stats(t.pitches.where(~_latest()), _METRICS), Q.robust_stats(t.pitches.where(_latest()), _METRICS)), "status"),
            ("categories", Q.appeared_or_vanished(Q.category_counts(t.pitches, _CATEGORIES, _latest())).withColumn("status", F.lit("warn")), "status"),
            ("duplicates", Q.judged(Q.duplicate_keys(t.base("lineitem"), ["l_orderkey", "l_linenumber"]), "surplus"), "status"),
            ("orphans", Q.judged(Q.referential_gap(t.pitches.select("game_pk"), t.games.where("status = 'Final'"), "game_pk"), "orphan_keys", "warn"), "status"),
        ),
        f"""with vs as (select status as st from ({_rated(_VIOLATIONS)})), {_BASELINE}, bs as (select {_SEVERITY} as st from s),
 ns as (select case when "column" = 'launch_angle' or abs(mv) <= {Q.MISSING_WARN} then 'pass' when abs(mv) > {Q.MISSING_ALERT} then 'fail' else 'warn' end as st from (select *, round(100.0 * latest_missing / latest_rows - 100.0 * baseline_missing / baseline_rows, 6) as mv from ({_NULLS}))),
 qb as ({_stats_sql('not ' + _L)}), ql as ({_stats_sql(_L)}), dj as (select qb.median as mb, ql.median as ml, qb.spread as sp from qb full join ql using (metric)),
 ds as (select {_SEVERITY} as st from (select 100.0 * (ml - mb) / nullif(mb, 0) as rel, case when sp > 0 then (ml - mb) / sp end as z from dj)),
 cs as (select 'warn' as st from ({' union all '.join(f"select '{c}' as col, cast({c} as varchar) as v, count(*) filter (where {_L}) as l, count(*) filter (where not {_L}) as b from pitches_v where {c} is not null group by 2" for c in _CATEGORIES)}) where (b = 0 and l >= 20) or (l = 0 and b >= 20)),
 us as (select case when sum(c) > count(*) then 'fail' else 'pass' end as st from (select count(*) as c from lineitem group by l_orderkey, l_linenumber)),
 os as (select case when count(*) > 0 then 'warn' else 'pass' end as st from pitches_v where game_pk not in (select game_pk from games_v where status = 'Final')),
 a as ({' union all '.join(f"select '{n}' as chk, st from {x}" for n, x in (('violations', 'vs'), ('volume', 'bs'), ('nulls', 'ns'), ('drift', 'ds'), ('categories', 'cs'), ('duplicates', 'us'), ('orphans', 'os')))}),
 names as (select unnest(['violations', 'volume', 'nulls', 'drift', 'categories', 'duplicates', 'orphans']) as chk)
select names.chk as "check", ['pass', 'known', 'warn', 'fail'][1 + coalesce(max(case st when 'fail' then 3 when 'warn' then 2 when 'known' then 1 else 0 end), 0)] as status, count(*) filter (where st in ('fail', 'warn')) as evidence
from names left join a on a.chk = names.chk group by 1""",
    ),
    "o1_latest_records": (
        lambda t: t.base("events").select("event_id", "ts", "user_id", "event_type").orderBy(F.desc_nulls_last("ts"), F.desc("event_id")).limit(100),
        "select event_id, ts, user_id, event_type from events order by ts desc nulls last, event_id desc limit 100",
    ),
    "o2_keyset_page": (
        lambda t: t.base("events").where("ts < timestamp_ntz '2024-01-20 00:00:00' or (ts = timestamp_ntz '2024-01-20 00:00:00' and event_id < 0)").select("event_id", "ts", "event_type").orderBy(F.desc("ts"), F.desc("event_id")).limit(50),
        "select event_id, ts, event_type from events where ts < timestamp '2024-01-20 00:00:00' or (ts = timestamp '2024-01-20 00:00:00' and event_id < 0) order by ts desc, event_id desc limit 50",
    ),
    "a27_freshness": (
        lambda t: Q.freshness({"games": (t.games, "game_date"), "events": (t.base("events"), "ts")}, F.lit("2024-01-31 12:00:00")).select("table_name", "n_rows", "stale"),
        "select 'games' as table_name, count(*) as n_rows, date_diff('second', max(game_date)::timestamp, timestamp '2024-01-31 12:00:00') > 36 * 3600 as stale from games_v union all select 'events', count(*), date_diff('second', max(ts), timestamp '2024-01-31 12:00:00') > 36 * 3600 from events",
    ),
    "a28_job_health": (
        lambda t: Q.job_health(t.base("events"), "event_type", F.col("value") > 20, "ts", F.lit("2024-02-01 00:00:00")).select("job", "runs", "successes", "age_minutes"),
        "select event_type as job, count(*) as runs, count(*) filter (where value > 20) as successes, cast(floor((epoch(timestamp '2024-02-01 00:00:00') - floor(epoch(max(ts) filter (where value > 20)))) / 60) as bigint) as age_minutes from events group by 1",
    ),
    "u2_distinct_keys": (
        lambda t: t.predictions.agg(F.count("*").alias("n"), F.countDistinct("game_pk", "at_bat_index", "pitch_number").alias("positions"), F.countDistinct("game_pk").alias("games")),
        "select count(*) as n, count(distinct (game_pk, at_bat_index, pitch_number)) as positions, count(distinct game_pk) as games from predictions_v",
    ),
}
