"""Compare queries with their SQL as the driver does."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def oracle(sql: str, sf_dir: str) -> pd.DataFrame:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return db.execute(sql).df()


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    columns = [[None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) or v is pd.NA else (int(v) if float(v).is_integer() else round(float(v), 12)) if isinstance(v, (int, float)) or hasattr(v, "dtype") and v.dtype.kind in "iuf" else str(v) for v in frame[c]] for c in frame.columns]
    return sorted(zip(*columns, strict=True), key=repr)


def differences(spark_frame: pd.DataFrame, oracle_frame: pd.DataFrame) -> str:
    if sorted(spark_frame.columns) != sorted(oracle_frame.columns):
        return f"columns {sorted(spark_frame.columns)} and {sorted(oracle_frame.columns)}"
    left, right = canonical(spark_frame), canonical(oracle_frame)
    if len(left) != len(right):
        return f"{len(left)} rows and {len(right)}"
    odd = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    return f"{len(odd)} rows differ: {odd[:2]}" if odd else ""
