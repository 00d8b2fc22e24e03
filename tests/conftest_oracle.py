"""Compare a query with its DuckDB SQL: rows, names and values."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def compare(spark, query, sql, sf_dir, con=None):
    con = con or connect(sf_dir)
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    rel = con.sql(sql)
    assert names == sorted(rel.columns), (names, rel.columns)
    want = sorted(repr([plain(v) for v in r]) for r in con.sql(f"SELECT {', '.join(chr(34) + n + chr(34) for n in names)} FROM ({sql})").fetchall())
    have = sorted(repr([plain(v) for v in r]) for r in got.select(*names).collect())
    assert len(have) == len(want), (len(have), len(want), have[:2], want[:2])
    diff = [(a, b) for a, b in zip(have, want) if a != b]
    assert not diff, diff[:3]
    return len(have)
