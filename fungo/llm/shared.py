"""Helpers that several training-data operators use: shared storage, lineage cuts, hashing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows handed to Python at once by the operators that read whole texts.
TEXTS_AT_ONCE = 500


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; where that is unset on a single
    machine (tests), a temporary folder is made and set on the context. On a
    cluster a folder of one machine would lose rows, so there it raises.
    """
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="fungo-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def small_batches(spark: SparkSession) -> None:
    """Hand whole texts to Python a few hundred at a time, where the session still has Spark's default.

    A batch of the default 10,000 rows can hold most of an executor's memory
    once documents are long.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(TEXTS_AT_ONCE))


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/fungo/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    The copy survives lost executors, cuts the lineage, and gives the optimiser
    the true size, so that it can choose a broadcast by itself.
    """
    path = new_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete the files of a staged frame that nothing reads any more."""
    spark = df.sparkSession
    for name in df.inputFiles()[:1]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever the case of letters."""
    have = {c.lower() for c in df.columns}
    found = f"__{name}"
    while found in have:
        found += "_"
    return found


def share(col: Column, salt: str) -> Column:
    """A number in [0, 1) that depends only on the value and the salt."""
    return (F.pmod(F.xxhash64(F.lit(salt), col.cast("string")), F.lit(1 << 40)) / F.lit(float(1 << 40))).cast("double")


def split_hot(rows: DataFrame, keys: list[str], id_col: str, block: int) -> DataFrame:
    """``rows`` for pairwise work inside each key, with columns bi, bj and side.

    A key of up to ``block`` rows is one group (0, 0). A larger one is cut into
    blocks by a hash of the id, and each pair of blocks is a group of its own:
    side 0 comes from block bi, side 1 from block bj, and within (b, b) all rows
    pair with each other. Every pair of rows meets in exactly one group.
    """
    hot = stage(rows.groupBy(*keys).count().where(F.col("count") > block).select(*keys, F.ceil(F.col("count") / block).cast("int").alias("blocks")), "hot_keys")
    own = F.pmod(F.xxhash64(id_col), F.col("blocks")).cast("int")
    to = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(own, o).alias("bi"), F.greatest(own, o).alias("bj"), (own > o).cast("int").alias("side")))
    alone = F.array(F.struct(F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("side")))
    return rows.join(hot, keys, "left").withColumn("to", F.explode(F.coalesce(to, alone))).select(*rows.columns, "to.*")
