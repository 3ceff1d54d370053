"""Holds a query against its DuckDB oracle."""

import os

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> pd.DataFrame:
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_bool_dtype(out[c]) or pd.api.types.is_numeric_dtype(out[c]):
            out[c] = out[c].astype(float)
        else:
            whole = out[c].map(lambda v: isinstance(v, bool) or v is None)
            out[c] = out[c].map(lambda v: None if v is None or v != v else float(v)).astype(float) if whole.all() and len(out) else out[c].map(lambda v: "" if v is None or v != v else str(v))
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def same(spark_df, sql, sf_dir=DATA):
    a, b = plain(spark_df.toPandas()), plain(connect(sf_dir).execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b, check_dtype=False, atol=2e-6, rtol=1e-9)
