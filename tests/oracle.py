"""Spark results against DuckDB on the same tables."""

import glob
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    held = duckdb.connect()
    held.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        for path in glob.glob(f"{sf_dir}/{table}.parquet"):
            held.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    return held


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return str(value) if not isinstance(value, (int, str, bool, type(None))) else value


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(_plain(v[i]) for i in order) for v in values), key=repr)


def compare(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    asked = connection(sf_dir).execute(sql)
    expected = rows([d[0] for d in asked.description], asked.fetchall())
    assert got[0] == expected[0]
    assert len(got[1]) == len(expected[1])
    wrong = [(a, b) for a, b in zip(got[1], expected[1], strict=True) if a != b]
    assert not wrong, wrong[:3]
