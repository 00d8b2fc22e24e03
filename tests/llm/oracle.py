"""Compare a query with its DuckDB SQL over given tables."""

import os

import duckdb


def same_as_sql(spark, query, sql, sf_dir, tables):
    got = query(spark, sf_dir)
    con = duckdb.connect()
    for t in tables:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    rel = con.sql(sql)
    names = sorted(rel.columns)
    assert names == sorted(got.columns)
    want = sorted(map(repr, con.sql(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()))
    have = sorted(repr(tuple(r)) for r in got.select(*names).collect())
    assert have == want
    return len(have)
