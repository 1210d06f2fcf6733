"""Every query of the library against its SQL on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from fungo.plans import catalog

SF = "/root/testdata/sf0.001"


def _normal(df: pd.DataFrame) -> pd.DataFrame:
    out = pd.DataFrame(index=df.index)
    for c in sorted(df.columns):
        cells = []
        for x in df[c].tolist():
            if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
                cells.append("")
            elif isinstance(x, bool) or isinstance(x, str):
                cells.append(str(x))
            elif isinstance(x, (int, float)):
                cells.append(repr(round(float(x), 8) + 0.0))
            else:
                cells.append(str(pd.Timestamp(x)) if hasattr(x, "year") else repr(round(float(x), 8) + 0.0))
        out[c] = cells
    return out.sort_values(list(out.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = _normal(catalog.QUERIES[name](spark, SF).toPandas())
    want = _normal(duck.sql(catalog.ORACLES[name]).df())
    assert list(got.columns) == list(want.columns)
    pd.testing.assert_frame_equal(got, want)
