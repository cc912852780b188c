"""Rows of a query against rows of its SQL, as sorted tuples with columns by name."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def rows(df: pd.DataFrame):
    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if hasattr(x, "dtype") and x.dtype.kind in "iuf":
            return float(x)
        return float(x) if isinstance(x, int | float) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.itertuples(index=False, name=None)), key=str)


def same(spark_df, duck, sql):
    got, want = spark_df.toPandas(), duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
