"""Tables that streams keep: versions behind a marker, and rollups of which only touched days are written again."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fungo.operators import grading as G

#: Days of one batch that a rollup writes again at most; a batch with more raises.
MOST_DAYS = 400


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []


def complete_versions(spark: SparkSession, path: str) -> list[int]:
    """Versions whose marker is there, oldest first. A version without one is still being written, or its writer died."""
    return sorted(int(n.removeprefix("complete-")) for n in _names(spark, path) if n.startswith("complete-"))


def read_version(spark: SparkSession, path: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The newest complete version (or a given one); an empty table before the first."""
    found = complete_versions(spark, path)
    if version is None and not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/version-{found[-1] if version is None else version}")


def write_version(df: DataFrame, path: str, version: int, keep: int = 3) -> None:
    """Write a version beside the others, mark it, and drop all but the newest ``keep``.

    The marker is made when all files are there, so no reader meets half a
    version; nothing is renamed. Writing a version again gives the same table.
    """
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/version-{version}")
    fs, marker = _fs(spark, f"{path}/complete-{version}")
    fs.create(marker, True).close()
    for old in complete_versions(spark, path)[:-keep]:
        for name in (f"complete-{old}", f"version-{old}"):  # the marker goes first
            fs.delete(_fs(spark, f"{path}/{name}")[1], True)


def mirror(path: str, schema: T.StructType, keys: Sequence[str], order: Sequence[str], alive: Column | None = None, keep: int = 3) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: the latest row of each key as a versioned table.

    Bounded by its keys and by ``alive``, which rows have to meet to stay (a game
    not final, a quote not expired). A batch that comes again builds on the
    version before it and gives the same one; a slow reader keeps the version it
    has, while newer ones are written.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        earlier = [v for v in complete_versions(spark, path) if v < epoch]
        if batch.isEmpty() and earlier:
            return
        old = read_version(spark, path, schema, earlier[-1]) if earlier else spark.createDataFrame([], schema)
        rest = [f.name for f in schema if f.name not in keys]
        both = old.unionByName(batch.select(*schema.names))
        new = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")
        write_version((new.where(alive) if alive is not None else new).select(*schema.names), path, epoch, keep)

    return run


def snapshot_every(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "30 seconds", mode: str = "update"):
    """Start a query that hands changes to ``sink`` by a processing-time trigger (without ``every``: over what is there, once)."""
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(sink)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()


def _batch_days(batch: DataFrame, day: str) -> list:
    days = [r[0] for r in batch.select(day).where(F.col(day).isNotNull()).distinct().limit(MOST_DAYS + 1).collect()]
    if len(days) > MOST_DAYS:
        raise ValueError(f"a batch touches more than {MOST_DAYS} days; lower its size")
    return sorted(days)


def latest_grades(spark: SparkSession, path: str, schema: T.StructType, days: Sequence, day: str = "day", key: str = "id", at: str = "graded_at") -> DataFrame:
    """The last grade of each call of these days; a call is read in its own days' files only."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("epoch", T.LongType())])).parquet(path).where(F.col(day).isin(list(days)))
    rest = [f.name for f in schema if f.name not in (key, day)]
    return rows.groupBy(key, day).agg(F.max_by(F.struct(*rest), F.struct(at, "epoch")).alias("r")).select(key, day, "r.*").select(*schema.names)


def late_grades(grades_path: str, rollup_path: str, schema: T.StructType, day: str = "day", key: str = "id", at: str = "graded_at", rollup: Callable[[DataFrame, str], DataFrame] = G.accuracy_rollup) -> Callable[[DataFrame, int], None]:
    """foreachBatch function: take grades in, however late, and write again the rollup of the days they touch.

    Grades lie by day and epoch, so a batch that comes again replaces its own
    files. Of a touched day the rollup is computed from its files alone and
    written over its partition; partitions and files of other days stay as they
    are. The whole table equals the rollup of all latest grades.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.where(F.col(day).isNotNull()).select(*schema.names).persist()
        try:
            days = _batch_days(rows, day)
            if not days:
                return
            rows.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day, "epoch").parquet(grades_path)
            new = rollup(latest_grades(spark, grades_path, schema, days, day, key, at), day)
            new.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rollup_path)
        finally:
            rows.unpersist()

    return run
