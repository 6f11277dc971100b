"""Compare a query's rows with its SQL's in DuckDB on the same tables."""

import datetime
import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    """A value as both engines would say it."""
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        v = float(v)
        return "nan" if math.isnan(v) else int(v) if v.is_integer() and abs(v) < 1e15 else float(f"{v:.9g}")
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if hasattr(v, "asDict"):
        return plain(v.asDict())
    return bytes(v) if isinstance(v, (bytearray, bytes)) else v


def duck_rows(sql, sf_dir=SF_DIR):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    found = db.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def compare(df, sql, sf_dir=SF_DIR):
    """Assert equal column names and equal rows, in any order."""
    names, rows = duck_rows(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    want = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    got = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    assert sum(got.values()) == sum(want.values())
    missing, extra = list((want - got).items())[:3], list((got - want).items())[:3]
    assert not missing and not extra, f"only in SQL: {missing}; only in Spark: {extra}"
    return len(rows)
