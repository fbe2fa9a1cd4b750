"""Compares queries with their SQL as DuckDB runs it."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        v = df[c]
        if pd.api.types.is_float_dtype(v) and not (v.dropna() % 1).any():
            v = v.astype("Int64") if v.notna().all() or True else v
        df[c] = v.map(lambda x: None if x is None or x is pd.NA or x != x else (round(float(x), 6) if isinstance(x, float) else (int(x) if hasattr(x, "__int__") and not isinstance(x, (str, bool)) else x)))
    return df.sort_values(list(df.columns), key=lambda s: s.map(str)).reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(spark_rows.columns)} and {sorted(sql_rows.columns)}"
    if len(spark_rows) != len(sql_rows):
        return f"{len(spark_rows)} and {len(sql_rows)} rows"
    a, b = canonical(spark_rows), canonical(sql_rows)
    for i in range(len(a)):
        x, y = a.iloc[i].tolist(), b.iloc[i].tolist()
        if [str(v) for v in x] != [str(v) for v in y]:
            return f"row {i}: {x} and {y}"
    return None
