"""Run a catalog query and its SQL side by side and compare all values."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connection(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    kept = [tuple(plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(kept, key=repr)


def differences(df, con, sql: str) -> list[str]:
    """Empty when both sides agree on columns, types of values and every row."""
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    want_names, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_names != want_names:
        return [f"columns {got_names} != {want_names}"]
    out = []
    if len(got) != len(want):
        out.append(f"rows {len(got)} != {len(want)}")
    if got != want:
        extra = [r for r in got if r not in set(want)][:3] if len(got) < 200_000 else got[:3]
        missing = [r for r in want if r not in set(got)][:3] if len(got) < 200_000 else want[:3]
        out.append(f"only in Spark {extra}; only in SQL {missing}")
    elif got and [type(v) for v in got[0]] != [type(v) for v in want[0]]:
        out.append(f"value types {got[0]} != {want[0]}")
    return out
