"""Run a registered Spark query and its DuckDB twin on the same parquet tables and compare
row count, column names and an order-insensitive value hash."""

from __future__ import annotations

import datetime as dt
import hashlib
import math
from decimal import Decimal

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(round(v, 9))
    if isinstance(v, Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_canon(x) for x in v) + "]"
    return str(v)


def canonical_rows(columns: list[str], rows: list[tuple]) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted("|".join(_canon(r[i]) for i in order) for r in rows)


def digest(lines: list[str]) -> str:
    h = hashlib.sha256()
    for line in lines:
        h.update(line.encode())
        h.update(b"\n")
    return h.hexdigest()


def compare(spark, fn, sql: str, sf_dir: str) -> dict:
    sdf = fn(spark, sf_dir)
    s_cols = sdf.columns
    s_rows = [tuple(r) for r in sdf.collect()]
    con = duck(sf_dir)
    rel = con.execute(sql)
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    s_lines = canonical_rows(s_cols, s_rows)
    d_lines = canonical_rows(d_cols, d_rows)
    out = {
        "rows_spark": len(s_rows), "rows_oracle": len(d_rows),
        "cols_match": sorted(s_cols) == sorted(d_cols),
        "hash_match": digest(s_lines) == digest(d_lines),
        "spark_cols": sorted(s_cols), "oracle_cols": sorted(d_cols),
    }
    if not out["hash_match"]:
        diff_s = sorted(set(s_lines) - set(d_lines))[:3]
        diff_d = sorted(set(d_lines) - set(s_lines))[:3]
        out["example_spark_only"] = diff_s
        out["example_oracle_only"] = diff_d
    return out
