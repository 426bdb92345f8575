"""Comparing a query's rows with DuckDB's for its SQL."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    return v.replace(tzinfo=None).isoformat() if isinstance(v, datetime.datetime) else repr(v)


def duck(sql, sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(norm(row[i]) for i in order) for row in r.fetchall())


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())
