"""Compare a Spark result with a DuckDB result as bags of rows."""

from __future__ import annotations

import datetime
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    return str(v)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple((type(plain(r[i])).__name__, plain(r[i])) for i in order) for r in rows)


def differences(df, con, sql):
    """A description of how the two differ, or None."""
    spark_rows = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    duck_columns = [d[0] for d in cur.description]
    duck_rows = cur.fetchall()
    if sorted(df.columns) != sorted(duck_columns):
        return f"columns {sorted(df.columns)} vs {sorted(duck_columns)}"
    ours, theirs = bag(spark_rows, df.columns), bag(duck_rows, duck_columns)
    if ours == theirs:
        return None
    a, b = ours - theirs, theirs - ours
    show = lambda c: [str(x)[:600] for x in list(c)[:2]]
    return f"{len(spark_rows)} vs {len(duck_rows)} rows; only Spark {sum(a.values())}: {show(a)}; only SQL {sum(b.values())}: {show(b)}"
