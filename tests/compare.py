"""Run a query and its SQL on the same tables and compare the rows whatever their order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def database(sf_dir: str):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        src = f"{p}/*.parquet" if os.path.isdir(p) else p
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{src}')")
    return db


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if hasattr(x, "asDict"):
        return tuple(sorted((k, plain(v)) for k, v in x.asDict().items()))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if type(x).__name__ == "Decimal":
        return float(x)
    return x


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(columns), sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def differences(spark, db, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    q = db.execute(sql)
    want = rows([d[0] for d in q.description], q.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows; first {got[1][:2]} and {want[1][:2]}"
    bad = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    if bad:
        return f"{len(bad)} of {len(got[1])} rows differ: {bad[0]}"
    if not got[1]:
        return "no rows"
    kinds = dict(df.dtypes)
    types = {d[0]: str(d[1]) for d in q.description}
    return "" if all(_same(kinds[c], types[c]) for c in kinds) else f"types {kinds} and {types}"


def _same(spark_type: str, duck: str) -> bool:
    ok = {"bigint": ("BIGINT",), "int": ("INTEGER",), "double": ("DOUBLE",), "string": ("VARCHAR",), "boolean": ("BOOLEAN", "BOOL")}
    return spark_type not in ok or duck.upper() in ok[spark_type]
