"""Run a registered query and its SQL side by side and compare exactly."""

from __future__ import annotations

import glob
import math
import os
import time

import duckdb


sqltime: list[float] = []


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _norm(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, float):
        return repr(value + 0.0)
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        (tuple(_norm(r[i]) for i in order) for r in rows), key=lambda t: tuple("" if v is None else v for v in t)
    )


def differences(spark_df, con, sql) -> list[str]:
    began = time.time()
    result = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in result.description], result.fetchall())
    sqltime.append(time.time() - began)
    got_cols, got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if want_cols != got_cols:
        return [f"columns {got_cols} instead of {want_cols}"]
    if len(want) != len(got):
        return [f"{len(got)} rows instead of {len(want)}", f"got {got[:2]}", f"want {want[:2]}"]
    return [f"got {g} want {w}" for g, w in zip(got, want) if g != w][:3]
