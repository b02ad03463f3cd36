"""Runs a registered query and its SQL twin and compares them."""

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    if hasattr(value, "as_integer_ratio"):
        return float(value)
    if hasattr(value, "isoformat"):
        return value.replace(tzinfo=None).isoformat() if hasattr(value, "tzinfo") else value.isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, query, sql, sf_dir):
    """None if the two agree in columns and rows, else what differs."""
    df = query(spark, sf_dir)
    con = connect(sf_dir)
    found = con.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    ours, theirs = rows_of(df.columns, [tuple(r) for r in df.collect()]), rows_of(names, found.fetchall())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} and {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b and not close(a, b)]
    return f"{len(bad)} rows differ, as {bad[:2]}" if bad else None


def close(a, b):
    return all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 1e-6 * max(1, abs(x), abs(y))) for x, y in zip(a, b, strict=True))
