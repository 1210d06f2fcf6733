"""Data quality: null counts, rule violations, histograms, robust baselines, drift, alignment and gaps."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Windows and limits of the robust rules.
BASELINE_ROWS, MIN_BASELINE = 28, 10
Z_WARN, Z_ALERT, FLOOR_PERCENT = 2.5, 3.5, 5.0
MAD_SCALE = 0.6745
RATE_MOVE_POINTS = 5.0
# Percent missing beyond which a column is flagged, and files of one write that make it a backfill.
MISSING_WARN, MISSING_ALERT, BACKFILL_FILES = 1.0, 5.0, 20

# What each value of a row must lie between (none: no limit), other conditions that no row should meet, and natural keys.
LIMITS = {
    "pitches": {"balls": (0, 3), "strikes": (0, 2), "outs": (0, 2), "inning": (1, None), "pitch_number": (1, None), "start_speed": (40, 110), "spin_rate": (None, 4000), "launch_speed": (None, 125)},
    "at_bats": {"pitch_count": (1, None), "inning": (1, None), "rbi": (0, 4)},
    "games": {"least(home_score, away_score)": (0, None), "temp_f": (0, 130), "attendance": (0, None)},
}
CONDITIONS = {
    "pitches": {"thrown more than a day off the game's day": "cast(pitch_ts as date) > game_date + 1 or cast(pitch_ts as date) < game_date - 1"},
    "at_bats": {"ends before it starts": "end_ts < start_ts"},
    "games": {"season is not the year of the day": "season <> year(game_date)"},
}
RULE_KEYS = {"pitches": ("game_pk", "at_bat_index", "pitch_number"), "at_bats": ("game_pk", "at_bat_index"), "games": ("game_pk",)}


def rules_of(dataset: str, columns: Sequence[str]) -> dict[str, str]:
    """The dataset's rules as SQL conditions that hold for a broken row; those on columns that are not there are left out."""
    have, word = set(columns), re.compile(r"[a-z_]+")
    found = {}
    for value, (low, high) in LIMITS[dataset].items():
        tests = [f"{value} < {low}"] * (low is not None) + [f"{value} > {high}"] * (high is not None)
        found[f"{value} outside {'' if low is None else low}..{'' if high is None else high}"] = " or ".join(tests)
    found |= CONDITIONS[dataset]
    found["part of the key missing"] = " or ".join(f"{k} is null" for k in RULE_KEYS[dataset])
    known = {"least", "cast", "as", "date", "or", "is", "null", "year"}
    return {name: test for name, test in found.items() if set(word.findall(test)) - known <= have}


HISTOGRAMS = {"start_speed": (55.0, 105.0, 50), "launch_speed": (10.0, 125.0, 46), "launch_angle": (-90.0, 90.0, 60)}


def null_counts(df: DataFrame, columns: Sequence[str], latest: Column) -> DataFrame:
    """Rows and missing values of each column in the latest part and before it, from one scan."""
    parts = {"latest": latest, "baseline": ~latest}
    aggs = [F.count_if(c).alias(f"{p}_rows") for p, c in parts.items()]
    aggs += [F.count_if(c & F.col(col).isNull()).alias(f"{p}__{col}") for p, c in parts.items() for col in columns]
    one = df.agg(*aggs)
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col("latest_rows"), F.col(f"latest__{c}").alias("latest_missing"), F.col("baseline_rows"), F.col(f"baseline__{c}").alias("baseline_missing")) for c in columns)))
    return one.select(rows.alias("x")).select("x.*")


def null_movers(counts: DataFrame, digits: int = 6) -> DataFrame:
    """Percentage-point shift of each column's missing share."""
    share = lambda p: F.try_divide(100.0 * F.col(f"{p}_missing"), F.nullif(F.col(f"{p}_rows"), F.lit(0)).cast("double"))
    return counts.select("column", F.round(share("latest"), digits).alias("latest_pct"), F.round(share("baseline"), digits).alias("baseline_pct"), F.round(share("latest") - share("baseline"), digits).alias("shift_pp"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows, distinct keys and rows too many."""
    d = df.groupBy(*keys).agg(F.count("*").alias("c"))
    return d.agg(F.sum("c").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("c") - F.count("*")).alias("surplus"))


def violations(df: DataFrame, rules: Mapping[str, str], latest: Column) -> DataFrame:
    """Rows that break each rule, in the latest part and before it, with a verdict on the movement.

    A rule that breaks for the first time fails; one whose rate moves is a
    warning; one that has always been broken at this rate is known.
    """
    aggs = [F.count_if(latest).alias("latest_rows"), F.count_if(~latest).alias("baseline_rows")]
    for i, rule in enumerate(rules.values()):
        broken = F.coalesce(F.expr(rule), F.lit(False))
        aggs += [F.count_if(broken & latest).alias(f"l{i}"), F.count_if(broken & ~latest).alias(f"b{i}")]
    rows = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col(f"l{i}").alias("latest"), F.col(f"b{i}").alias("baseline"), F.col("latest_rows"), F.col("baseline_rows")) for i, name in enumerate(rules))))
    out = df.agg(*aggs).select(rows.alias("x")).select("x.*")
    rate = lambda p: F.try_divide(100.0 * F.col(p), F.nullif(F.col(f"{p}_rows"), F.lit(0)).cast("double"))
    out = out.withColumns({"latest_rate": F.round(rate("latest"), 6), "baseline_rate": F.round(rate("baseline"), 6)})
    moved = F.abs(F.col("latest_rate") - F.col("baseline_rate")) > RATE_MOVE_POINTS
    return out.withColumn("status", F.when(F.col("latest") == 0, "pass").when(F.col("baseline") == 0, "fail").when(F.col("baseline_rate").isNull(), "warn").when(moved, "warn").otherwise("known"))


def histograms(df: DataFrame, bins: Mapping[str, tuple[float, float, int]], latest: Column) -> DataFrame:
    """Counts in fixed bins, values outside held in the outer bins."""
    values = F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("v"), F.lit(lo).alias("lo"), F.lit((hi - lo) / n).alias("step"), F.lit(n).alias("n")) for c, (lo, hi, n) in bins.items())))
    x = df.select(latest.alias("latest"), values.alias("x")).select("latest", "x.*").where("v is not null")
    b = F.greatest(F.lit(0), F.least(F.col("n") - 1, F.floor((F.col("v") - F.col("lo")) / F.col("step")).cast("int")))
    return x.groupBy("metric", b.alias("bin"), "lo", "step").agg(F.count_if("latest").alias("latest_n"), F.count_if(~F.col("latest")).alias("baseline_n")).select("metric", "bin", F.round(F.col("lo") + F.col("bin") * F.col("step"), 6).alias("bin_start"), "latest_n", "baseline_n")


def weighted_quantiles(counted: DataFrame, wanted: Sequence[float], buckets: int = 64) -> DataFrame:
    """(metric, q): exact quantiles, in order of ``wanted``, of values with counts (metric, value, n); a map from place to value.

    Values are dealt to buckets between approximate quantiles, so each task sorts
    a part of a metric's values; counts of whole buckets give where a part begins.
    Any cuts give the same answer, they only share out the work.
    """
    present = counted.where(F.col("value").isNotNull())
    cuts = present.groupBy("metric").agg(F.percentile_approx("value", [i / buckets for i in range(1, buckets)], 10_000).alias("cuts"))  # a row a metric
    placed = present.join(F.broadcast(cuts), "metric").withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = placed.groupBy("metric", "bucket").agg(F.sum("n").alias("inside"))
    w = Window.partitionBy("metric")
    before = F.coalesce(F.sum("inside").over(w.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("metric", "bucket", before.alias("before"), F.sum("inside").over(w).alias("total"))  # a row a metric and bucket
    upto = F.col("before") + F.sum("n").over(Window.partitionBy("metric", "bucket").orderBy("value"))
    run = placed.join(F.broadcast(offsets), ["metric", "bucket"]).withColumn("upto", upto)
    parts = []
    for i, q in enumerate(wanted):
        at = F.lit(q) * (F.col("total") - 1)
        low, high = F.floor(at), F.ceil(at)
        parts.append(F.struct(F.lit(i).alias("i"), low.alias("k"), F.when(low == high, 1.0).otherwise(high - at).alias("w")))
        parts.append(F.struct(F.lit(i).alias("i"), high.alias("k"), F.when(low == high, 0.0).otherwise(at - low).alias("w")))
    mine = F.filter(F.array(*parts), lambda x: (x["k"] < F.col("upto")) & (x["k"] >= F.col("upto") - F.col("n")))
    hits = run.select("metric", "value", F.explode(mine).alias("x"))
    found = hits.groupBy("metric", "x.i").agg(F.sum(F.col("value") * F.col("x.w")).alias("v"))
    return found.groupBy("metric").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("q"))  # a few entries


def robust_stats(df: DataFrame, columns: Sequence[str], digits: int = 6, accuracy: int | None = None) -> DataFrame:
    """5th, 50th and 95th percentile, a robust spread (IQR / 1.349) and missing share of each column.

    Equal values are counted first and the exact quantiles taken over parts of
    the values; with ``accuracy`` they are those of ``percentile_approx``.
    """
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns))).alias("x")).select("x.*")
    places = (0.05, 0.25, 0.5, 0.75, 0.95)
    present = F.count_if(F.col("value").isNotNull()) if accuracy else F.sum(F.when(F.col("value").isNotNull(), F.col("n")))
    if accuracy is None:
        counted = long.groupBy("metric", "value").agg(F.count("*").alias("n"))
        sizes = counted.groupBy("metric").agg(F.sum("n").alias("n_rows"), F.coalesce(present, F.lit(0)).alias("present"))
        x = sizes.join(weighted_quantiles(counted, places), "metric", "left")
    else:
        entries = F.percentile_approx("value", list(places), accuracy)
        x = long.groupBy("metric").agg(entries.alias("a"), F.count("*").alias("n_rows"), present.alias("present"))
        x = x.withColumn("q", F.map_from_entries(F.transform("a", lambda v, i: F.struct(i, v))))
    at = lambda i: F.round(F.try_element_at("q", F.lit(i)), digits)
    spread = F.round((F.try_element_at("q", F.lit(3)) - F.try_element_at("q", F.lit(1))) / 1.349, digits)
    missing = F.round(F.try_divide(100.0 * (F.col("n_rows") - F.col("present")), F.col("n_rows").cast("double")), digits)
    return x.select("metric", at(0).alias("p05"), at(2).alias("median"), at(4).alias("p95"), spread.alias("spread"), missing.alias("null_pct"))


def severity(z: Column, relative: Column, floor: float = FLOOR_PERCENT) -> Column:
    """Both a large robust score and a move past the floor are needed to flag."""
    big = F.abs(relative) > floor
    return F.when(relative.isNull() | ~big, "pass").when(z.isNull(), F.when(F.abs(relative) > 3 * floor, "fail").otherwise("warn")).when(F.abs(z) > Z_ALERT, "fail").when(F.abs(z) > Z_WARN, "warn").otherwise("pass")


def drift(baseline: DataFrame, latest: DataFrame, digits: int = 6) -> DataFrame:
    """Shift of each metric's median, in percent and in the baseline's spread."""
    b = baseline.select("metric", F.col("median").alias("median_base"), F.col("spread").alias("spread_base"))
    j = b.join(latest.select("metric", F.col("median").alias("median_latest")), "metric", "full")
    moved = F.col("median_latest") - F.col("median_base")
    rel = F.try_divide(100.0 * moved, F.nullif(F.col("median_base"), F.lit(0.0)))
    shift = F.when(rel.isNotNull() & (F.col("spread_base") > 0), moved / F.col("spread_base"))
    return j.select("metric", "median_base", "median_latest", F.round(rel, digits).alias("change_pct"), F.round(shift, digits).alias("shift_mad"), severity(shift, rel).alias("status"))


def category_counts(df: DataFrame, columns: Sequence[str], latest: Column) -> DataFrame:
    """Rows of each value of each column, in the latest part and before it."""
    v = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(latest.alias("latest"), v.alias("x")).where("x.value is not null").groupBy("x.column", "x.value").agg(F.count_if("latest").alias("latest_n"), F.count_if(~F.col("latest")).alias("baseline_n"))


def appeared_or_vanished(counts: DataFrame, support: int = 20) -> DataFrame:
    """Values on one side only, with enough rows on it."""
    kind = F.when((F.col("baseline_n") == 0) & (F.col("latest_n") >= support), "appeared").when((F.col("latest_n") == 0) & (F.col("baseline_n") >= support), "vanished")
    return counts.withColumn("change", kind).where("change is not null")


def _median(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, ((n - 1) / 2).cast("int")) + F.get(s, (n / 2).cast("int"))) / 2


def trailing_baseline(df: DataFrame, keys: Sequence[str], day: str, metric: str, rows: int = BASELINE_ROWS, least: int = MIN_BASELINE, floor: float = FLOOR_PERCENT, digits: int = 6) -> DataFrame:
    """Each row against median and MAD of the ``rows`` rows before it (rows that exist, not calendar days)."""
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(-rows, -1)
    x = df.withColumn("__past", F.collect_list(F.col(metric).cast("double")).over(w)).withColumn("__past", F.when(F.size("__past") >= least, F.col("__past")))
    x = x.withColumn("__median", _median(F.col("__past")))
    x = x.withColumn("__mad", _median(F.transform("__past", lambda v: F.abs(v - F.col("__median")))))
    rel = F.try_divide(100.0 * (F.col(metric) - F.col("__median")), F.nullif(F.col("__median"), F.lit(0.0)))
    z = F.when(F.col("__mad") > 0, MAD_SCALE * (F.col(metric) - F.col("__median")) / F.col("__mad"))
    return x.select(*df.columns, F.col("__median").alias(f"{metric}_median"), F.round("__mad", digits).alias(f"{metric}_mad"), F.round(rel, digits).alias(f"{metric}_rel_pct"), F.round(z, digits).alias(f"{metric}_z"), severity(z, rel, floor).alias(f"{metric}_status"))


def day_gaps(days: DataFrame, day: str = "day", keys: Sequence[str] = ()) -> DataFrame:
    """Runs of missing days inside each year's span, for each key by itself."""
    d = days.select(*keys, F.col(day).alias("d")).distinct().withColumn("season", F.year("d"))
    following = F.lead("d").over(Window.partitionBy(*keys, "season").orderBy("d"))
    gaps = d.withColumn("n", following).where("datediff(n, d) > 1")
    return gaps.select(*keys, "season", F.date_add("d", 1).alias("from_day"), F.date_sub("n", 1).alias("to_day"), (F.datediff("n", "d") - 1).alias("days"))


def last_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The last n rows of each key (a top-k operator)."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def with_group_size(df: DataFrame, keys: Sequence[str], name: str = "batch_size", flag: str = "is_backfill", above: int = 20) -> DataFrame:
    """Rows that share a key, and whether there are so many that they came in one pass."""
    sizes = df.groupBy(*keys).agg(F.count("*").alias(name))
    return df.join(sizes, list(keys)).withColumn(flag, F.col(name) > above)


def alignment(ledger: DataFrame, datasets: Sequence[str], reference: str) -> DataFrame:
    """Days on which datasets are missing or disagree on the number of games."""
    p = ledger.groupBy("day").pivot("dataset", list(datasets)).agg(F.sum("rows_n").alias("rows"), F.sum("games").alias("games"))
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{d}_rows").isNull(), F.lit(d)) for d in datasets))), ",")
    off = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{d}_games") != F.col(f"{reference}_games"), F.lit(d)) for d in datasets))), ",")
    return p.select("day", missing.alias("missing"), off.alias("game_mismatch"), F.round(F.try_divide(F.col(f"{datasets[0]}_rows").cast("double"), F.col(f"{datasets[1]}_rows").cast("double")), 6).alias("ratio"))


def referential_gap(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Fact rows and distinct keys without a row in the dimension."""
    o = facts.join(dimension.select(key).distinct(), key, "left_anti")
    return o.groupBy(key).count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys"))


def dataset_totals(ledger: DataFrame) -> DataFrame:
    """Days, rows and span of each dataset."""
    return ledger.groupBy("dataset").agg(F.count("*").alias("days"), F.sum("rows_n").alias("total_rows"), F.sum("games").alias("total_games"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


def verdicts(*checks: tuple[str, DataFrame, str]) -> DataFrame:
    """One row for each check: its worst status and how many rows were not fine. ``checks``: (id, rows, status column)."""
    rank = lambda c: F.when(F.col(c) == "fail", 3).when(F.col(c) == "warn", 2).when(F.col(c) == "known", 1).otherwise(0)
    out = None
    for name, rows, status in checks:
        r = rows.agg(F.lit(name).alias("check"), F.coalesce(F.max(rank(status)), F.lit(0)).alias("r"), F.count_if(F.col(status).isin("fail", "warn")).alias("evidence"))
        out = r if out is None else out.unionByName(r)
    return out.select("check", F.element_at(F.array(*(F.lit(s) for s in ("pass", "known", "warn", "fail"))), F.col("r") + 1).alias("status"), "evidence")


def moved_nulls(movers: DataFrame, structural: Sequence[str] = ()) -> DataFrame:
    """``null_movers`` with a verdict on the shift; columns that lack values by design pass."""
    shift = F.abs(F.coalesce("shift_pp", F.lit(0.0)))
    quiet = F.col("column").isin(list(structural)) | (shift <= MISSING_WARN)
    return movers.withColumn("status", F.when(quiet, "pass").when(shift > MISSING_ALERT, "fail").otherwise("warn"))


def judged(counts: DataFrame, column: str, bad: str = "fail") -> DataFrame:
    """One row of counts with a verdict: ``bad`` where the count is not zero."""
    return counts.withColumn("status", F.when(F.col(column) > 0, bad).otherwise("pass"))


def freshness(tables: Mapping[str, tuple[DataFrame, str]], as_of: Column, stale_hours: int = 36) -> DataFrame:
    """Rows, newest instant and staleness of each named table (frame, time column)."""
    out = None
    for name, (df, ts) in tables.items():
        r = df.agg(F.lit(name).alias("table_name"), F.count("*").alias("n_rows"), F.max(F.col(ts).cast("timestamp")).alias("newest"))
        out = r if out is None else out.unionByName(r)
    hours = (F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("newest")) / 3600
    return out.withColumns({"age_hours": F.round(hours, 4), "stale": F.coalesce(hours > stale_hours, F.lit(True))})


def job_health(runs: DataFrame, job: str, ok: Column, finished: str, as_of: Column) -> DataFrame:
    """Last success of each job and the minutes since; null where a job never succeeded."""
    g = runs.groupBy(F.col(job).alias("job")).agg(F.count("*").alias("runs"), F.count_if(ok).alias("successes"), F.max(F.when(ok, F.col(finished).cast("timestamp"))).alias("last_success"))
    return g.withColumn("age_minutes", F.floor((F.unix_timestamp(as_of.cast("timestamp")) - F.unix_timestamp("last_success")) / 60).cast("long"))


def missingness(df: DataFrame, columns: Sequence[str], structural: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """Missing values of each column with a severity; columns that lack values by design are never flagged."""
    one = df.agg(F.count("*").alias("n_rows"), *(F.count(c).alias(f"c{i}") for i, c in enumerate(columns)))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"c{i}").alias("present"), F.lit(c in structural).alias("structural")) for i, c in enumerate(columns)))
    rows = one.select("n_rows", F.explode(parts).alias("x")).select("n_rows", "x.*")
    pct = F.coalesce(F.try_divide(100.0 * (F.col("n_rows") - F.col("present")), F.col("n_rows").cast("double")), F.lit(0.0))
    level = F.when(F.col("structural") | (pct <= MISSING_WARN), "ok").when(pct > MISSING_ALERT, "alert").otherwise("warn")
    return rows.select("column", (F.col("n_rows") - F.col("present")).alias("missing"), F.round(pct, digits).alias("missing_pct"), "present", "structural", level.alias("severity"))


def ingest_frame(ledger: DataFrame, digits: int = 6) -> DataFrame:
    """Ledger days with rows a game, bytes a row, days from game to write, and whether the write was a backfill."""
    batch = with_group_size(ledger.withColumn("written", F.to_date("ingested_at")), ["dataset", "written"], "batch_files", "from_backfill", BACKFILL_FILES)
    per = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), digits)
    lag = (F.unix_timestamp("ingested_at") - F.unix_timestamp(F.col("day").cast("timestamp"))) / 86_400
    return batch.select("dataset", "day", "rows_n", "games", "bytes", per("rows_n", "games").alias("rows_per_game"), per("bytes", "rows_n").alias("bytes_per_row"), F.round(lag, digits).alias("lag_days"), "batch_files", "from_backfill")


# Least games and rows for a verdict on a day, floor of the file-size rule, lag limits in days, and newest days judged for lag.
LEAST_GAMES, LEAST_FILE_ROWS, BYTES_FLOOR_PERCENT = 3, 3_000, 15.0
LAG_WARN, LAG_ALERT, LAG_JUDGED_DAYS = 3.0, 5.0, 14


def scored_days(frame: DataFrame, digits: int = 6) -> DataFrame:
    """``ingest_frame`` rows with a status for rows a game, bytes a row and lag, the rows to expect, and the worst status.

    Days of too few games or rows are in the baselines but pass; lag is judged
    on each dataset's newest days, backfills left out.
    """
    x = trailing_baseline(frame, ["dataset"], "day", "rows_per_game", digits=digits)
    x = trailing_baseline(x, ["dataset"], "day", "bytes_per_row", floor=BYTES_FLOOR_PERCENT, digits=digits)
    newest = F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("day")))
    late = F.when(F.col("lag_days") > LAG_ALERT, "fail").when(F.col("lag_days") > LAG_WARN, "warn").otherwise("pass")
    x = x.withColumn("__newest", newest).withColumns({
        "rows_per_game_status": F.when(F.col("games") >= LEAST_GAMES, F.col("rows_per_game_status")).otherwise("pass"),
        "bytes_per_row_status": F.when(F.col("rows_n") >= LEAST_FILE_ROWS, F.col("bytes_per_row_status")).otherwise("pass"),
        "lag_days_status": F.when((F.col("__newest") <= LAG_JUDGED_DAYS) & ~F.col("from_backfill"), late).otherwise("pass"),
        "expected_rows": F.round(F.col("rows_per_game_median") * F.col("games"), 3),
    })
    names = F.array(F.col("rows_per_game_status"), F.col("bytes_per_row_status"), F.col("lag_days_status"))
    worst = F.when(F.array_contains(names, "fail"), "fail").when(F.array_contains(names, "warn"), "warn").otherwise("pass")
    return x.withColumn("status", worst).drop("__newest")


def sampled_days(ledger: DataFrame, n: int, seed: int) -> DataFrame:
    """A seeded random sample of ledger days (a sampling operator): those of least hash."""
    return ledger.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), "dataset", F.col("day").cast("string"))), "dataset", "day").limit(n)


def newest_rows(df: DataFrame, order: Sequence[Column], columns: Sequence[str], n: int = 20) -> DataFrame:
    """A preview of a table (a top-k report)."""
    return df.orderBy(*order).select(*columns).limit(n)
