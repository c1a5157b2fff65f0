"""Compare registered queries with DuckDB on the same Parquet tables, rows in any order."""

from __future__ import annotations

import math

import duckdb

from labelkite.session import TABLES


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, bool):
        return v
    return v if isinstance(v, (int, str, bytes)) or v is None else str(v).removesuffix("+00:00")


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty where both agree, else what differs."""
    df = query(spark, sf_dir)
    want = con.execute(sql)
    names = [c[0] for c in want.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    a, b = rows(df.columns, df.collect()), rows(names, want.fetchall())
    if a == b:
        return ""
    in_a, in_b = set(a), set(b)
    only = [x for x in a if x not in in_b][:2], [x for x in b if x not in in_a][:2]
    return f"{len(a)} and {len(b)} rows; only in Spark {only[0]}, only in DuckDB {only[1]}"
