"""Holds a query against its SQL form on the same files, as sorted rows."""

from __future__ import annotations

import math
import os

import pandas as pd

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle_frame(sql: str, sf_dir: str) -> pd.DataFrame:
    import duckdb

    with duckdb.connect() as con:
        con.execute("set timezone = 'UTC'")
        for t in TABLES:
            path = f"{sf_dir}/{t}.parquet"
            if os.path.exists(path):
                con.execute(f"create view {t} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
        return con.execute(sql).df()


def rows_of(frame: pd.DataFrame) -> list[tuple]:
    """Rows with columns by name, as text, sorted; missing values are all alike."""
    frame = frame[sorted(frame.columns)]
    text = lambda v: "" if v is None or v is pd.NaT or v is pd.NA or v != v else repr(float(v)) if isinstance(v, (float, int)) and not isinstance(v, bool) else str(v)
    return sorted(zip(*([text(v.item() if hasattr(v, "item") else v) for v in frame[c]] for c in frame.columns), strict=True))


def _same(x: str, y: str) -> bool:
    """Equal, or numbers that agree to all digits but the last of a rounded double."""
    try:
        return x == y or math.isclose(float(x), float(y), rel_tol=1e-9)
    except ValueError:
        return False


def difference(spark_frame: pd.DataFrame, oracle: pd.DataFrame) -> str:
    """Empty if both hold the same rows, else what differs first."""
    if sorted(spark_frame.columns) != sorted(oracle.columns):
        return f"columns {sorted(spark_frame.columns)} against {sorted(oracle.columns)}"
    a, b = rows_of(spark_frame), rows_of(oracle)
    if len(a) != len(b):
        return f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b, strict=True) if x != y and not all(map(_same, x, y))]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else ""
