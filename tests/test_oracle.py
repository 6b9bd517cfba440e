"""Every registered query with an oracle against DuckDB, over the driver's smallest tables where they are at hand."""

import math
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from glyphmill import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    return c


def rows(df):
    def cell(x):
        return None if x is None or x is pd.NA or (isinstance(x, float) and math.isnan(x)) else round(float(x), 6) if isinstance(x, float) else x

    return sorted((tuple(cell(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_oracle(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, str(DATA)).toPandas(), duck.execute(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
