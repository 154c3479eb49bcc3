"""Compares a registered query with its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or value != value:
        return None
    return float(value) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


def compare(spark, query, sql, sf_dir=SF):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    wanted = db.sql(sql)
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    assert columns == sorted(wanted.columns)
    ours = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    index = [wanted.columns.index(c) for c in columns]
    theirs = sorted(repr([plain(r[i]) for i in index]) for r in wanted.fetchall())
    assert ours == theirs
