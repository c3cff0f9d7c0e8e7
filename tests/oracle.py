"""Compares a query with its SQL in DuckDB."""

import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _value(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return None
    if isinstance(x, numbers.Number) or hasattr(x, "dtype") and x.dtype.kind in "iufb":
        return None if x != x else float(x)
    return str(pd.Timestamp(x)) if isinstance(x, pd.Timestamp) else str(x)


def rows(frame, columns):
    return sorted(repr(tuple(map(_value, r))) for r in frame[columns].itertuples(index=False, name=None))


def same(df, con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = pd.DataFrame(cur.fetchall(), columns=names)
    got = df.toPandas()
    assert sorted(got.columns) == sorted(names)
    columns = sorted(names)
    a, b = rows(got, columns), rows(want, columns)
    assert a == b, [(x, y) for x, y in zip(a, b) if x != y][:3]
    return len(a)
