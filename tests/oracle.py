"""Compares a registered query with its SQL twin, row for row."""

import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages"
          " benchmark labels conversations").split()


def connect(directory):
    db = duckdb.connect()
    for name in TABLES:
        db.sql(f"create view {name} as select * from read_parquet('{directory}/{name}.parquet')")
    return db


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value + 0.0, 9)
    if hasattr(value, "as_tuple"):
        return float(value)
    return value


def compare(spark_df, db, sql):
    """None when equal, else a short account of the difference."""
    expected = db.sql(sql)
    names = sorted(expected.columns)
    if sorted(spark_df.columns) != names:
        return f"columns {sorted(spark_df.columns)} vs {names}"
    left = [tuple(plain(r[n]) for n in names) for r in spark_df.collect()]
    order = [expected.columns.index(n) for n in names]
    right = [tuple(plain(r[i]) for i in order) for r in expected.fetchall()]
    key = lambda row: tuple((v is not None, str(type(v)), v) for v in row)
    left, right = sorted(left, key=lambda r: str(key(r))), sorted(right, key=lambda r: str(key(r)))
    if left == right:
        return None
    off = [(a, b) for a, b in zip(left, right) if a != b][:2]
    return f"{len(left)} vs {len(right)} rows, {names}: {off}"[:900]
