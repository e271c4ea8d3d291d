"""Run a query and its SQL on the same tables."""

import os

import duckdb

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, query, sql, folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = query(spark, folder)
    names = sorted(df.columns)
    rows = [tuple(r[n] for n in names) for r in df.collect()]
    res = con.execute(sql)
    have = [c[0] for c in res.description]
    assert sorted(have) == names
    want = [tuple(r[have.index(n)] for n in names) for r in res.fetchall()]
    key = lambda r: tuple(repr(round(x, 9) if isinstance(x, float) else x) for x in r)
    assert sorted(map(key, rows)) == sorted(map(key, want))
    return rows
