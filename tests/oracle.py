"""Holds every query that has SQL against DuckDB on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir):
    con = duckdb.connect(config={"memory_limit": "2GB", "threads": 2})
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return round(value, 6) + 0.0
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(spark, con, function, sql, sf_dir):
    got = function(spark, sf_dir)
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    b = rows_of(names, found.fetchall())
    assert sorted(got.columns) == sorted(names), (sorted(got.columns), sorted(names))
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(p == q or (isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-6 * max(1, abs(p))) for p, q in zip(x, y, strict=True))]
    assert not bad, bad[:3]
    return len(a)
