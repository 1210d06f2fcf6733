"""Exports of own output: by game day, planned from what the target already holds, and cold dumps in key ranges that are read back."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.sources.datasets import _struct

# Columns and types of the exported datasets.
EXPORTS: dict[str, T.StructType] = {
    k: _struct(v)
    for k, v in {
        "predictions": "id long, game_pk long, official_date date, at_bat_index int, pitch_number int, market string, predicted_value double, confidence double, probs string, recommendation string, line double, price int, edge double, units double, result string, actual_value double, actual_label string, profit_units double, graded_at timestamp, model_version string, created_at timestamp, book string, backfilled_at timestamp",
        "picks": "id long, pick_date date, game_pk long, at_bat_index int, market string, recommendation string, label string, line double, price int, confidence double, edge double, units double, book string, source string, model_version string, status string, profit_units double, payload string, created_at timestamp, graded_at timestamp",
        "game_predictions": "game_pk long, market string, phase string, official_date date, predicted_value double, probs string, recommendation string, confidence double, line double, price int, edge double, book string, home_team_id int, away_team_id int, home_pitcher_id int, away_pitcher_id int, actual_value double, result string, profit_units double",
    }.items()
}
DAY_OF = {"predictions": "official_date", "picks": "pick_date", "game_predictions": "official_date"}
ORDER_OF = {"predictions": "id", "picks": "id", "game_predictions": "game_pk"}
#: Rows of a file in a cold dump.
MOST_ROWS = 1_000_000


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it is not there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def exported_days(spark: SparkSession, path: str, dataset: str) -> set[date]:
    """Days of a dataset that the target holds: one listing of the dataset's folder, no file is read."""
    return {date.fromisoformat(n.removeprefix("day=")) for n in _files(spark, f"{path}/{dataset}") if n.startswith("day=")}


def typed(rows: DataFrame, dataset: str) -> DataFrame:
    """Rows in the dataset's declared types; a column that is missing or null throughout keeps its type, maps and structs become JSON text."""
    out, have = [], {f.name: f.dataType for f in rows.schema}
    for f in EXPORTS[dataset]:
        c = F.col(f.name) if f.name in have else F.lit(None)
        nested = isinstance(have.get(f.name), (T.MapType, T.StructType, T.ArrayType))
        out.append((F.to_json(c) if nested else c.try_cast(f.dataType)).alias(f.name))
    return rows.select(*out)


def export_days(sources: Mapping[str, DataFrame], games: DataFrame, path: str, days: Sequence[date], skip_existing: bool = False) -> DataFrame:
    """Write each dataset's rows of these Eastern game days, a folder a day; returns (dataset, day, rows, skipped) for every pair asked.

    Predictions carry no day: they belong to the day of their game, which is
    written on them. A day is written anew as a whole, which is how late grades
    reach it; with ``skip_existing`` days of which the target holds every dataset
    are left out, and only those. A day without rows makes no folder, so it does
    not count as held and is tried again. Nothing is read of days not asked for
    where the sources are partitioned by day.
    """
    spark = games.sparkSession
    held = {d: exported_days(spark, path, d) for d in sources} if skip_existing else {}
    skipped = {d for d in days if held and all(d in h for h in held.values())}
    todo = sorted(set(days) - skipped)
    facts = [spark.createDataFrame([(ds, d) for ds in sources for d in sorted(skipped)], "dataset string, day date").select("dataset", "day", F.lit(0).cast("long").alias("rows"), F.lit(True).alias("skipped"))]
    if todo:
        slate = games.where(F.col("game_date").isin(todo)).groupBy("game_pk").agg(F.max("game_date").alias("official_date"))
        asked = spark.createDataFrame([(d,) for d in todo], "day date")
        for dataset, rows in sources.items():
            own = rows.drop("official_date").join(slate, "game_pk") if dataset == "predictions" else rows.where(F.col(DAY_OF[dataset]).isin(todo))
            shaped = typed(own, dataset).withColumn("day", F.col(DAY_OF[dataset]))
            target = f"{path}/{dataset}"
            shaped.repartition("day").sortWithinPartitions("day", ORDER_OF[dataset]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("day").parquet(target)
            # what was written is counted from the files
            written = read_export(spark, path, dataset).where(F.col("day").isin(todo)).groupBy("day").agg(F.count("*").alias("rows")) if _files(spark, target) else spark.createDataFrame([], "day date, rows long")
            own_days = shaped.groupBy("day").agg(F.count("*").alias("own"))
            counted = asked.join(own_days, "day", "left").join(written, "day", "left")
            facts.append(counted.select(F.lit(dataset).alias("dataset"), "day", F.when(F.col("own").isNotNull(), F.coalesce("rows", F.lit(0))).otherwise(0).cast("long").alias("rows"), F.lit(False).alias("skipped")))
    out = facts[0]
    for f in facts[1:]:
        out = out.unionByName(f)
    return out


def read_export(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    return spark.read.schema(T.StructType([*EXPORTS[dataset].fields, T.StructField("day", T.DateType())])).parquet(f"{path}/{dataset}")


def _sums(rows: DataFrame, key: str, *by: str | Column) -> DataFrame:
    mark = F.xxhash64(*(F.col(c) for c in sorted(c for c in rows.columns if c not in ("day", "file"))))
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"), F.sum(mark.cast("decimal(20,0)")).alias("mark"))


def cold_dump(rows: DataFrame, path: str, key: str = "id", ts: str = "created_at", most: int = MOST_ROWS) -> DataFrame:
    """Write a table as files of neighbouring keys under its UTC days, and compare what can be read with what was to be written.

    Keys above the greatest one at the start are left to the next dump, so rows
    that come in meanwhile move nothing. Ranges are cut by sampled quantiles of
    (day, key, row), so a key with very many rows is cut as well, one task writes
    a range, and no file holds over ``most`` rows. Rows without an instant lie
    under ``unknown``. Returns the ranges (day, file, rows, first_key, last_key,
    mark); days or sums that differ raise, and so does an empty table.
    """
    spark = rows.sparkSession
    top = rows.agg(F.max(key).alias("top"), F.count("*").alias("n")).first()
    if not top["n"]:
        raise ValueError("nothing to dump")
    fixed = rows.where(F.col(key).isNull() | (F.col(key) <= F.lit(top["top"])))
    names = [c for c in rows.columns if c != "day"]
    days = fixed.select(*names).withColumn("day", F.coalesce(F.date_format(F.col(ts), "yyyy-MM-dd"), F.lit("unknown")))
    cuts = days.repartitionByRange(ceil(top["n"] / most), "day", key, F.xxhash64(*names)).sortWithinPartitions("day", key)
    cuts.write.mode("overwrite").option("maxRecordsPerFile", most).option("compression", "zstd").partitionBy("day").parquet(path)
    ranges = dumped_ranges(spark, path, days.schema, key)
    _compare(_sums(days, key, "day"), ranges)
    return ranges


def dumped_ranges(spark: SparkSession, path: str, schema: T.StructType, key: str = "id") -> DataFrame:
    """The ranges that a dump's files hold, by reading them."""
    read = spark.read.schema(schema).parquet(path).withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return _sums(read, key, "day", "file")


def _compare(wanted: DataFrame, ranges: DataFrame) -> None:
    found = ranges.groupBy("day").agg(F.sum("rows").alias("f_rows"), F.sum("mark").alias("f_mark"))
    wanted = wanted.groupBy("day").agg(F.sum("rows").alias("rows"), F.sum("mark").alias("mark"))
    off = wanted.join(found, "day", "full").where(~F.col("rows").eqNullSafe(F.col("f_rows")) | ~F.col("mark").eqNullSafe(F.col("f_mark")))
    bad = [r["day"] for r in off.orderBy("day").limit(20).collect()]
    if bad:
        raise ValueError(f"the dump does not hold what was written on {', '.join(map(str, bad))}")


def verify_dump(spark: SparkSession, path: str, schema: T.StructType, ranges: DataFrame, key: str = "id") -> None:
    """Raise if a dump no longer holds the ranges noted when it was made (a lost, added or changed file)."""
    _compare(ranges, dumped_ranges(spark, path, schema, key))
