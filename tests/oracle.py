"""Compares a query with its SQL on the second engine."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: v.tolist() if hasattr(v, "tolist") else v).map(repr)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(spark, query, sql, sf_dir, replace=None):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    a, b = _plain(query(spark, sf_dir).toPandas()), _plain(con.execute(sql).df())
    assert list(a.columns) == list(b.columns)
    assert len(a) == len(b)
    assert a.equals(b)
