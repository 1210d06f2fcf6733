"""Predictors from frequencies on tables where pitchers have enough rows to be known."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from fungo.plans import catalog

SF = "/root/testdata/sf0.01"
KEY = ["game_pk", "at_bat_index", "pitch_number"]


@pytest.mark.parametrize("name", ["r7_frequency_pitch_result", "r7_frequency_pa_result"])
def test_known_pitchers_equal_sql(spark, name):
    with duckdb.connect() as con:
        con.sql("set timezone='UTC'")
        for p in Path(SF).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        want = con.sql(catalog.ORACLES[name]).df().sort_values(KEY, ignore_index=True)
    got = catalog.QUERIES[name](spark, SF).toPandas().sort_values(KEY, ignore_index=True)
    assert got["features_used"].str.startswith("pitcher_freq").any()  # the smallest tables know no pitcher
    pd.testing.assert_frame_equal(got[sorted(got)], want[sorted(want)], check_dtype=False, rtol=0, atol=2e-8)
