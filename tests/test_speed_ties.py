"""Expected speeds that lie on a rounding tie, as they do once a pitcher has thrown enough for the full weight."""

from __future__ import annotations

from datetime import datetime

import duckdb
import pandas as pd
from pyspark.sql import functions as F

from fungo.functions import predicates as P
from fungo.plans import catalog

KEY = ["game_pk", "at_bat_index", "pitch_number"]


def _tables(spark, folder, games=4_000):
    """One pitcher with 12,000 fastballs at 90.1 on one day, and a game of every count on the next."""
    # every 41st order has the same pitcher; the first day's supplier 12 throws fastballs
    order = F.col("id") * 41
    first = spark.range(games).select(order.alias("k"), F.lit(datetime(1996, 5, 1)).alias("at"), F.lit(0).cast("long").alias("n"))
    then = spark.range(12).select((order + games * 41).alias("k"), F.lit(datetime(1996, 5, 2)).alias("at"), F.col("id").alias("n"))
    both = first.unionByName(then)
    both.selectExpr("k as o_orderkey", "k as o_custkey", "'F' as o_orderstatus", "1d as o_totalprice", "at as o_orderdate", "'1' as o_orderpriority").write.parquet(f"{folder}/orders.parquet")
    lines = both.selectExpr("k as l_orderkey", "n as l_partkey", "12 + n div 4 as l_suppkey", "explode(sequence(1, 3)) as l_linenumber", "25.25d as l_quantity", "1d as l_extendedprice", "0.1d as l_discount", "0.1d as l_tax", "'N' as l_returnflag", "'O' as l_linestatus", "at as l_shipdate")
    lines.write.parquet(f"{folder}/lineitem.parquet")


def test_speeds_on_a_tie_equal_sql(spark, tmp_path):
    _tables(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.sql("set timezone='UTC'")
        for name in ("orders", "lineitem"):
            con.sql(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
        want = con.sql(catalog.ORACLES["r3_r8_speed_over_line"]).df().sort_values(KEY, ignore_index=True)
    got = catalog.QUERIES["r3_r8_speed_over_line"](spark, str(tmp_path)).toPandas().sort_values(KEY, ignore_index=True)
    assert 88.31 in set(want["mu"])
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False, rtol=0, atol=2e-8)


def test_rounding_of_ties(spark):
    told = {88.30499999999999: 88.31, 88.475: 88.48, 88.07499999999999: 88.07, -88.30499999999999: -88.31, 0.0: 0.0, 1.004: 1.0}
    rows = spark.createDataFrame([(x,) for x in told], "x double").select("x", P.rounded(F.col("x"), 2).alias("y")).collect()
    assert {r["x"]: r["y"] for r in rows} == told
    assert spark.range(1).select(P.rounded(F.lit(None).cast("double"), 2).alias("y")).first()["y"] is None
