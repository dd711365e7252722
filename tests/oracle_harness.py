"""Differential check: a registered Spark query vs its DuckDB oracle text.

Rows are compared as an order-insensitive multiset after normalising values
(decimals and floats to 6 places, timestamps and dates to ISO text), with
columns taken in name order — the way the driver compares.
"""

from __future__ import annotations

import collections
import datetime as dt
import decimal
import math

import duckdb

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
                 "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in DRIVER_TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 6)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((k, norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return norm(v.asDict())
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    rows = [tuple(norm(r[c]) for c in cols) for r in df.select(*cols).collect()]
    return cols, rows


def duck_rows(con, text):
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = [tuple(norm(r[i]) for i in order) for r in cur.fetchall()]
    return [names[i] for i in order], rows


def compare(spark, name: str, sf_dir: str, queries: dict, oracle: dict, con=None) -> dict:
    con = con or duck(sf_dir)
    df = queries[name](spark, sf_dir)
    s_cols, s_rows = spark_rows(df)
    d_cols, d_rows = duck_rows(con, oracle[name])
    res = {"name": name, "spark_rows": len(s_rows), "oracle_rows": len(d_rows),
           "columns_match": s_cols == d_cols}
    if s_cols != d_cols:
        res["spark_cols"], res["oracle_cols"] = s_cols, d_cols
    cs, cd = collections.Counter(s_rows), collections.Counter(d_rows)
    res["values_match"] = cs == cd
    if cs != cd:
        res["only_spark"] = list((cs - cd).elements())[:3]
        res["only_oracle"] = list((cd - cs).elements())[:3]
    res["ok"] = res["columns_match"] and res["values_match"]
    return res
