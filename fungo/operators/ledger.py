"""Verdicts over the ledger of written days: eight questions, a row each, with the days that speak against it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days judged, and the limits of each question.
RECENT_DAYS, VERIFY_DAYS, GAP_DAYS = 7, 3, 14
WRITE_WARN_HOURS, WRITE_FAIL_HOURS = 30.0, 48.0
BEHIND_WARN_DAYS, BEHIND_FAIL_DAYS = 3, 4
GAP_WARN, GAP_FAIL = 1, 3
PITCHES_PER_PA, PA_PER_GAME = (3.4, 4.4), (60.0, 95.0)
#: What a verdict row holds. Evidence is text of the form dataset:day, in order.
VERDICT = "check string, status string, headline string, evidence array<string>"
DATASETS = ("pitches", "at_bats", "games")


def newest(rows: DataFrame, n: int, by: str = "dataset", day: str = "day") -> DataFrame:
    """The last ``n`` days that each dataset has."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(day)))).where(F.col("__n") <= n).drop("__n")


def _evidence(against: Column, name: Column) -> Column:
    return F.array_sort(F.collect_list(F.when(against, name)))


def _file() -> Column:
    return F.concat_ws(":", "dataset", F.col("day").cast("string"))


def _verdict(one: DataFrame, check: str, status: Column, headline: Column, evidence: Column | None = None) -> DataFrame:
    return one.select(F.lit(check).alias("check"), status.alias("status"), headline.alias("headline"), (evidence if evidence is not None else F.array().cast("array<string>")).alias("evidence"))


def _levels(value: Column, warn: Column | float, fail: Column | float, at_least: bool = True) -> Column:
    over = (lambda limit: value >= limit) if at_least else (lambda limit: value > limit)
    return F.when(over(fail), "fail").when(over(warn), "warn").otherwise("pass")


def _text(pattern: str, *parts: Column) -> Column:
    return F.format_string(pattern, *parts)


def freshness(ledger: DataFrame, now: Column) -> DataFrame:
    """Hours since anything was written; a write in the future is a clock that is wrong."""
    one = ledger.agg(F.max("ingested_at").alias("at"))
    hours = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp("at")) / 3600.0
    status = F.when(F.col("at").isNull(), "fail").when(hours < -1, "warn").otherwise(_levels(hours, WRITE_WARN_HOURS, WRITE_FAIL_HOURS, at_least=False))
    said = F.when(F.col("at").isNull(), "no write times").when(hours < -1, _text("newest write %.1fh in the future", -hours)).otherwise(_text("last write %.1fh ago", hours))
    return _verdict(one, "freshness", status, said)


def currency(ledger: DataFrame, today: Column) -> DataFrame:
    """Days by which the newest game day trails."""
    one = ledger.agg(F.max("day").alias("day"))
    behind = F.datediff(today, "day")
    status = F.when(F.col("day").isNull(), "fail").otherwise(_levels(behind, BEHIND_WARN_DAYS, BEHIND_FAIL_DAYS))
    return _verdict(one, "currency", status, F.when(F.col("day").isNull(), "no days").otherwise(_text("newest game day %s, %dd behind", F.col("day").cast("string"), behind)))


def _worst(column: str) -> Column:
    rank = F.max(F.when(F.col(column) == "fail", 2).when(F.col(column) == "warn", 1).otherwise(0))
    return F.when(rank == 2, "fail").when(rank == 1, "warn").otherwise("pass").alias("status")


def off_baseline(scored: DataFrame, check: str, column: str, what: str) -> DataFrame:
    """The worst status of a scored figure over recent days of each dataset."""
    recent = newest(scored, RECENT_DAYS)
    one = recent.agg(_worst(column), F.count("*").alias("n"), _evidence(F.col(column) != "pass", _file()).alias("against"))
    bad = F.size("against")
    said = F.when(bad == 0, _text(f"{what} normal across %d recent files", F.col("n"))).otherwise(_text("%d file(s) off baseline", bad))
    return _verdict(one, check, F.col("status"), said, F.col("against"))


def lag(scored: DataFrame) -> DataFrame:
    """How long after the games files appeared; the median is that of nightly writes."""
    recent = newest(scored, RECENT_DAYS)
    own = F.when(~F.col("from_backfill"), F.col("lag_days"))
    one = recent.agg(_worst("lag_days_status"), F.percentile(own, 0.5).alias("median"), F.count(own).alias("n"), _evidence(F.col("lag_days_status") != "pass", _file()).alias("against"))
    said = F.when(F.col("median").isNull(), "no nightly writes").otherwise(_text("median lag %.1fd over %d nightly files", F.round("median", 1), F.col("n")))
    return _verdict(one, "lag", F.col("status"), said, F.col("against"))


def aligned(ledger: DataFrame) -> DataFrame:
    """Whether the datasets are all there, name the same games and hold them in usual proportion, on recent days."""
    rows, games = ({d: F.max(F.when(F.col("dataset") == d, F.col(c))) for d in DATASETS} for c in ("rows_n", "games"))
    days = ledger.groupBy("day").agg(*(c.alias(f"{d}_rows") for d, c in rows.items()), *(c.alias(f"{d}_games") for d, c in games.items()))
    # one row a day; the last few of them
    last = days.orderBy(F.desc("day")).limit(RECENT_DAYS)
    missing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"{d}_rows").isNull(), F.lit(d)) for d in sorted(DATASETS)))), ", ")
    agree = F.coalesce((F.col("pitches_games") == F.col("games_games")) & (F.col("at_bats_games") == F.col("games_games")), F.lit(False))
    within = lambda a, b, r: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")).between(*r), F.lit(False))
    bad = (missing != "") | ~agree | ~within("pitches_rows", "at_bats_rows", PITCHES_PER_PA) | ~within("at_bats_rows", "games_games", PA_PER_GAME)
    marked = last.select("day", missing.alias("missing"), bad.alias("bad"))
    one = marked.agg(F.count_if("bad").alias("n"), F.count_if(F.col("bad") & (F.col("missing") != "")).alias("gone"), _evidence(F.col("bad"), F.concat_ws(":", F.nullif(F.col("missing"), F.lit("")), F.col("day").cast("string"))).alias("against"))
    said = F.when(F.col("n") == 0, "all datasets agree on every recent day").otherwise(_text("%d recent day(s) disagree", F.col("n")))
    return _verdict(one, "alignment", F.when(F.col("n") == 0, "pass").when(F.col("gone") > 0, "fail").otherwise("warn"), said, F.col("against"))


def verification(ledger: DataFrame) -> DataFrame:
    """Share of each dataset's newest days that were derived anew and agreed."""
    recent = newest(ledger, VERIFY_DAYS)
    ok = F.col("verified_at").isNotNull()
    one = recent.agg(F.count("*").alias("n"), F.count_if(ok).alias("ok"), _evidence(~ok, _file()).alias("against"))
    status = F.when((F.col("n") > 0) & (F.col("ok") == F.col("n")), "pass").when(F.col("ok") > 0, "warn").otherwise("fail")
    return _verdict(one, "verification", status, _text("%d of %d newest files verified", F.col("ok"), F.col("n")), F.col("against"))


def gaps(ledger: DataFrame, today: Column, dataset: str = "games") -> DataFrame:
    """Days without a file inside a season's span, over the recent past.

    The calendar of a season runs from its first to its last day on file; what a
    run of days lacks is found by a left join with the days present, and a run
    counts with its whole length if it ends in the period.
    """
    present = ledger.where(F.col("dataset") == dataset).select("day").where("day is not null").distinct()
    span = present.groupBy(F.year("day").alias("season")).agg(F.min("day").alias("a"), F.max("day").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("day"))  # a row a day of the years on file
    gone = calendar.join(present.withColumn("held", F.lit(True)), "day", "left").where("held is null").select("day")
    # a run has one number: the day less its place among the missing days of the year
    number = F.datediff("day", F.lit("1970-01-01")) - F.row_number().over(Window.partitionBy(F.year("day")).orderBy("day"))
    runs = gone.select("day", number.alias("run")).groupBy(F.year("day").alias("season"), "run").agg(F.min("day").alias("a"), F.max("day").alias("b"), F.count("*").alias("days"))
    recent = F.col("b") >= F.date_sub(today, GAP_DAYS)
    one = runs.agg(F.coalesce(F.sum(F.when(recent, F.col("days"))), F.lit(0)).alias("n"), _evidence(recent, F.concat_ws("..", F.col("a").cast("string"), F.col("b").cast("string"))).alias("against"))
    said = F.when(F.col("n") == 0, f"no missing days in the last {GAP_DAYS}").otherwise(_text(f"%d missing day(s) in the last {GAP_DAYS}", F.col("n")))
    return _verdict(one, "gaps", _levels(F.col("n"), GAP_WARN, GAP_FAIL), said, F.col("against"))


def verdicts(ledger: DataFrame, scored: DataFrame, now: Column) -> DataFrame:
    """All eight verdicts. ``ledger``: dataset, day, rows_n, games, ingested_at, verified_at; ``scored`` as ``quality.scored_days`` gives it."""
    today = F.to_date(now.cast("timestamp"))
    parts = [
        freshness(ledger, now),
        currency(ledger, today),
        off_baseline(scored, "volume", "rows_per_game_status", "rows per game"),
        aligned(ledger),
        lag(scored),
        off_baseline(scored, "size", "bytes_per_row_status", "bytes per row"),
        verification(ledger),
        gaps(ledger, today),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def overall(found: DataFrame) -> DataFrame:
    """The worst status and the counts behind it, in words."""
    g = found.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "fail").alias("failing"), F.count_if(F.col("status") == "warn").alias("watching"))
    parts = F.concat_ws(", ", F.when(F.col("failing") > 0, _text("%d failing", F.col("failing"))), F.when(F.col("watching") > 0, _text("%d to watch", F.col("watching"))))
    said = F.when(F.col("failing") + F.col("watching") == 0, _text("%d checks pass", F.col("n"))).otherwise(F.concat(parts, _text(" of %d checks", F.col("n"))))
    return g.select(F.when(F.col("failing") > 0, "fail").when(F.col("watching") > 0, "warn").otherwise("pass").alias("status"), said.alias("summary"))
