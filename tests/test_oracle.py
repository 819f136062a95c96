"""Every registered query of the semantic layer against its DuckDB SQL on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from spindle import demo

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if df[c].dtype.kind == "f":
            df[c] = df[c].round(6)
        df[c] = [None if pd.isna(v) else str(v) for v in df[c]]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def number_like(a: pd.DataFrame, b: pd.DataFrame) -> None:
    for c in a.columns:
        if a[c].dtype.kind in "fiu" or b[c].dtype.kind in "fiu":
            a[c], b[c] = a[c].astype("float64"), b[c].astype("float64")


@pytest.mark.parametrize("name", list(demo.QUERIES))
def test_matches_sql(spark, sf, duck, name):
    a, b = demo.queries()[name](spark, sf).toPandas(), duck.sql(demo.SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    number_like(a, b)
    pd.testing.assert_frame_equal(canonical(a), canonical(b), check_dtype=False)
