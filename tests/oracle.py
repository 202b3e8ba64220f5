"""Order-insensitive comparison of a frame with DuckDB."""

import datetime
import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def value(v):
    if isinstance(v, bool) or v is None or isinstance(v, int):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return tuple(map(value, v)) if isinstance(v, (list, tuple)) else str(v)


def rows(columns, data):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(value(r[i]) for i in at) for r in data), key=repr)


def wanted(sql, sf_dir=None, frames=None):
    c = duckdb.connect()
    for t in TABLES if sf_dir else ():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for name, df in (frames or {}).items():
        c.register(name, df)
    r = c.execute(sql)
    return sorted(x[0] for x in r.description), rows([x[0] for x in r.description], r.fetchall())


def assert_same(df, sql, sf_dir=None, frames=None):
    columns, want = wanted(sql, sf_dir, frames)
    assert sorted(df.columns) == columns
    assert rows(df.columns, df.collect()) == want
