"""Compares a query's rows with those of its SQL, as sets of rows with columns ordered by name."""

import glob
import math
import os


def tables(con, folder):
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"create or replace view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(f"{v:.9g}") if abs(v) < 1 << 53 else v
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "hour") else v.isoformat()
    return float(v) if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, con, run, sql, folder):
    """None if both give the same rows, else what differs."""
    df = run(spark, folder)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got == want:
        return None
    a, b = set(map(repr, got)), set(map(repr, want))
    return f"{len(got)} and {len(want)} rows; only here {sorted(a - b)[:3]}; only there {sorted(b - a)[:3]}"
