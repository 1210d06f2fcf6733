"""Datasets: frozen schemas, day partitions, the audit ledger, publishing and retention."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T



def _struct(text: str) -> T.StructType:
    """A flat schema from "name type" pairs."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


# Columns, types and keys of the datasets.
SCHEMAS: dict[str, T.StructType] = {
    k: _struct(v)
    for k, v in {
        "pitches": "game_pk long, at_bat_index int, pitch_number int, pitcher_id int, batter_id int, game_date date, pitch_ts timestamp, balls int, strikes int, outs int, inning int, top_inning boolean, men_on_base string, bat_side string, pitch_hand string, pitch_of_game int, start_speed double, zone int, description string, result_category string, is_ball boolean, is_in_play boolean, pitch_type string, launch_speed double, launch_angle double",
        "at_bats": "game_pk long, at_bat_index int, pitcher_id int, batter_id int, game_date date, pitch_count int, men_on_base string, bat_side string, pitch_hand string, result string, result_detail string",
        "games": "game_pk long, game_date date, season int, game_type string, status string, home_team_id int, away_team_id int, home_score int, away_score int, venue_id int, temp_f int",
        "players": "player_id int, full_name string, bat_side string, pitch_hand string, position string, debut_date date, birth_date date",
    }.items()
}
KEYS = {"pitches": ["game_pk", "at_bat_index", "pitch_number"], "at_bats": ["game_pk", "at_bat_index"], "games": ["game_pk"], "players": ["player_id"]}
LEDGER = _struct("dataset string, day date, rows long, games long, checksum string, ingested_at timestamp, verified_at timestamp, verified_by string")


def shaped(df: DataFrame, dataset: str) -> DataFrame:
    """Rows in the dataset's schema: columns selected and cast, missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*((F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in SCHEMAS[dataset]))


def read_dataset(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """Never inferred: the declared schema, and the partition columns of the layout."""
    parts = _struct("year int, month int, day date")
    return spark.read.schema(T.StructType([*SCHEMAS[dataset].fields, *parts.fields])).parquet(path)


def write_days(df: DataFrame, dataset: str, path: str, day: str = "game_date") -> None:
    """Replace the days that ``df`` holds and no others. Writing the same rows again changes nothing."""
    parts = shaped(df, dataset).withColumns({"year": F.year(day), "month": F.month(day), "day": F.col(day)})
    # one writer a day unless a day is large; AQE splits what is too large for one
    parts.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("year", "month", "day").parquet(path)


def whole_days(df: DataFrame, failed: Column, day: str = "game_date") -> DataFrame:
    """Rows of days on which nothing failed: a day is taken whole or not at all."""
    bad = df.where(failed).select(day).distinct()
    return df.join(bad, day, "left_anti")


def pending_days(schedule: DataFrame, ledger: DataFrame, first: Column, last: Column, most: int, day: str = "day") -> DataFrame:
    """Scheduled days of a window that the ledger lacks. Raises on reading if they are ``most`` or more."""
    window = schedule.where(F.col(day).between(first, last)).select(day).distinct()
    todo = window.join(ledger.select(day).distinct(), day, "left_anti")
    n = todo.agg(F.count("*").alias("n"))
    return todo.join(F.broadcast(n)).withColumn("n", F.when(F.col("n") >= most, F.raise_error(F.lit("the window is saturated"))).otherwise(F.col("n"))).where("n is not null").drop("n")


def day_checksums(df: DataFrame, keys: Sequence[str], day: str = "game_date", exact: bool = False) -> DataFrame:
    """(day, rows, games, checksum) by natural keys, whatever the order of rows.

    The default adds up 48 bits of each key's MD5, so it needs no list of a
    day's keys and a key that comes twice counts twice; ``exact`` gives the
    SHA-256 of the sorted keys.
    """
    key = F.concat_ws("|", *(F.col(k).cast("string") for k in keys))
    if exact:
        check = F.sha2(F.array_join(F.array_sort(F.collect_list(key)), "\n"), 256)
    else:
        check = F.sum(F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("decimal(18,0)")).cast("string")
    return df.groupBy(F.col(day).alias("day")).agg(F.count("*").alias("rows"), F.countDistinct("game_pk").alias("games"), check.alias("checksum"))


def record_ingest(ledger: DataFrame, sums: DataFrame, dataset: str, at: Column) -> DataFrame:
    """The ledger with new entries for these days. An entry written anew loses its verification."""
    fresh = sums.select(F.lit(dataset).alias("dataset"), "day", "rows", "games", "checksum", at.cast("timestamp").alias("ingested_at"), F.lit(None).cast("timestamp").alias("verified_at"), F.lit(None).cast("string").alias("verified_by"))
    return ledger.join(fresh.select("dataset", "day"), ["dataset", "day"], "left_anti").unionByName(fresh)


def verify_days(ledger: DataFrame, derived: DataFrame, read_back: DataFrame) -> DataFrame:
    """Each day of an independent derivation against the ledger and the stored files, with what disagrees."""
    j = ledger.select("day", F.col("rows").alias("rows_l"), F.col("checksum").alias("sum_l")).join(derived.select("day", F.col("rows").alias("rows_d"), F.col("checksum").alias("sum_d")), "day", "full").join(read_back.select("day", F.col("rows").alias("rows_b"), F.col("checksum").alias("sum_b")), "day", "full")
    reasons = F.array_compact(F.array(F.when(~F.col("rows_l").eqNullSafe(F.col("rows_d")), "rows"), F.when(~F.col("sum_l").eqNullSafe(F.col("sum_d")), "checksum"), F.when(~F.col("rows_b").eqNullSafe(F.col("rows_d")) | ~F.col("sum_b").eqNullSafe(F.col("sum_d")), "readback")))
    return j.select("day", (F.size(reasons) == 0).alias("ok"), F.array_join(reasons, ",").alias("reasons"))


def record_verified(ledger: DataFrame, verified: DataFrame, at: Column, by: str) -> DataFrame:
    """Mark days that passed; those that failed lose the mark, others keep theirs."""
    v = verified.select("day", "ok")
    j = ledger.join(v, "day", "left")
    when = F.when(F.col("ok"), at.cast("timestamp")).when(~F.col("ok"), None).otherwise(F.col("verified_at"))
    who = F.when(F.col("ok"), F.lit(by)).when(~F.col("ok"), None).otherwise(F.col("verified_by"))
    return j.withColumns({"verified_at": when, "verified_by": who}).select(*ledger.columns)


def ledgered(df: DataFrame, ledger: DataFrame, day: str = "game_date", verified_only: bool = False) -> DataFrame:
    """Rows of days that the ledger holds (and has verified)."""
    days = ledger.where("verified_at is not null") if verified_only else ledger
    return df.join(days.select(F.col("day").alias(day)).distinct(), day, "left_semi")


def recent_seasons(df: DataFrame, n: int = 3, day: str = "game_date") -> DataFrame:
    return df.select(F.year(day).alias("season")).distinct().orderBy(F.desc("season")).limit(n)


def new_rows(snapshot: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Insert-ignore: the snapshot and the rows with unseen keys. Null key parts compare as equal."""
    unseen = rows.dropDuplicates(list(keys))
    s = snapshot.select(*(F.col(k).alias(f"__{k}") for k in keys)).distinct()
    cond = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return snapshot.unionByName(unseen.join(s, cond, "left_anti"))


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """Latest wins: one row a key, of new rows before old and then by ``order``."""
    both = table.withColumn("__new", F.lit(0)).unionByName(rows.withColumn("__new", F.lit(1)))
    rest = [c for c in table.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("r")).select(*keys, "r.*").select(*table.columns)


def publish(df: DataFrame, path: str) -> int:
    """Write beside the target, refuse to go on without rows, then swap the two folders.

    The old table is moved aside and not deleted before the new one has taken
    its place; if that fails it is moved back.
    """
    spark, staging, aside = df.sparkSession, f"{path}.staging", f"{path}.old"
    df.write.mode("overwrite").parquet(staging)
    n = spark.read.schema(df.schema).parquet(staging).count()
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    new, old, kept = (hadoop.Path(x) for x in (staging, path, aside))
    fs = new.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not n:
        fs.delete(new, True)
        raise ValueError("nothing to publish")
    fs.delete(kept, True)
    was_there = fs.exists(old)
    if was_there and not fs.rename(old, kept):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if was_there:
            fs.rename(kept, old)
        raise OSError(f"cannot put the new table at {path}")
    fs.delete(kept, True)
    return n


def json_safe(df: DataFrame) -> DataFrame:
    """NaN and infinities as nulls; days and instants as ISO text."""
    out = []
    for f in df.schema:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        out.append(c.alias(f.name))
    return df.select(*out)


def prune(df: DataFrame, day: str, as_of: Column, keep_days: int) -> DataFrame:
    """Rows of the last ``keep_days`` days."""
    return df.where(F.col(day) >= F.date_sub(as_of, keep_days))


def hot_window(df: DataFrame, ledger: DataFrame, day: str, as_of: Column, keep_days: int = 35) -> DataFrame:
    """Rows of the newest ``keep_days`` days, and older ones whose day the ledger does not hold as verified."""
    safe = ledger.where("verified_at is not null").select(F.col("day").alias("__day")).distinct()
    older = F.col(day) < F.date_sub(as_of, keep_days)
    return df.join(safe, older & (F.col(day) == F.col("__day")), "left_anti")


def ledger_of_old(old: DataFrame) -> DataFrame:
    """Ledger rows of the first layout in today's: its ``verified_at`` was the write time, and no row counts as verified."""
    moved = old.withColumn("ingested_at", F.col("verified_at").cast("timestamp")).drop("verified_at")
    none = {"verified_at": F.lit(None).cast("timestamp"), "verified_by": F.lit(None).cast("string")}
    return moved.withColumns({"games": F.coalesce("games", F.lit(0)), **none})


def prune_quotes(odds: DataFrame, keys: Sequence[str], as_of: Column, keep_days: int = 14, ts: str = "fetched_at") -> DataFrame:
    """Young quotes, and of the old ones the last of each key."""
    k = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in keys]
    last = F.row_number().over(Window.partitionBy(*k).orderBy(F.desc(ts), F.desc("id")))
    return odds.withColumn("__n", last).where((F.col(ts) >= F.date_sub(as_of, keep_days)) | (F.col("__n") == 1)).drop("__n")


def coerce(rows: DataFrame, dataset: str, formats: Mapping[str, str] | None = None) -> DataFrame:
    """Text rows in the dataset's types; what does not parse is null."""
    have, formats = set(rows.columns), formats or {}
    out = []
    for f in SCHEMAS[dataset]:
        c = F.col(f.name) if f.name in have else F.lit(None).cast("string")
        if isinstance(f.dataType, T.TimestampType):
            c = F.try_to_timestamp(c, F.lit(formats[f.name])) if f.name in formats else F.try_to_timestamp(c)
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)):
            c = F.bround(c.try_cast("double")).cast(f.dataType)
        else:
            c = c.try_cast(f.dataType.simpleString())
        out.append(c.alias(f.name))
    return rows.select(*out)
