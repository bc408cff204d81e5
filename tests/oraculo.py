"""Driver-style check: run a registered query in Spark and its oracle SQL in DuckDB, compare
column names, row count and the multiset of normalised rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from matricula.sources.preparacion import BASE


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for b in BASE:
        con.execute(f"CREATE VIEW {b} AS SELECT * FROM read_parquet('{sf_dir}/{b}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        try:
            v = v.item()
        except Exception:
            pass
    if isinstance(v, float):
        if math.isnan(v):
            return None
        if v.is_integer():
            return int(v)
        return round(v, 9)
    if isinstance(v, decimal.Decimal):
        return _norm(float(v))
    if isinstance(v, bool):
        return v
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return v


def filas_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def filas_duck(con, sql):
    rel = con.sql(sql)
    nombres = rel.columns
    cols = sorted(nombres)
    idx = [nombres.index(c) for c in cols]
    return cols, [tuple(_norm(r[i]) for i in idx) for r in rel.fetchall()]


def comparar(spark, con, fn, sql, sf_dir):
    sc, sr = filas_spark(fn(spark, sf_dir))
    dc, dr = filas_duck(con, sql)
    clave = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    ok = sc == dc and sorted(sr, key=clave) == sorted(dr, key=clave)
    return ok, (sc, dc, len(sr), len(dr), sorted(set(sr) - set(dr), key=clave)[:3], sorted(set(dr) - set(sr), key=clave)[:3])
