"""Run registered queries beside their SQL and compare rows."""

import math

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def oracle(sf_dir: str, sql: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).df()


def cell(v):
    if v is None or v is pd.NA:
        return None
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if hasattr(v, "item"):
        v = v.item()
        if isinstance(v, float) and math.isnan(v):
            return "nan"
    if isinstance(v, float):
        return float(repr(v))
    if hasattr(v, "tolist"):
        v = v.tolist()
    return tuple(v) if isinstance(v, list) else v


def normal_rows(rows, names):
    order = sorted(names)
    out = [tuple(cell(r[n]) for n in order) for r in rows]
    return order, sorted(out, key=repr)


def same(spark_df, sql_df):
    """None when equal, else a short text about the difference."""
    got_names, got = normal_rows([r.asDict() for r in spark_df.collect()], spark_df.columns)
    want_names, want = normal_rows(sql_df.astype(object).where(sql_df.notna() | sql_df.isna(), None).to_dict("records"),
                                   list(sql_df.columns))
    if got_names != want_names:
        return f"columns {got_names} != {want_names}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    norm = lambda row: tuple(None if v == "nan" else (float(v) if isinstance(v, (int, float)) else v) for v in row)
    g, w = sorted(map(norm, got), key=repr), sorted(map(norm, want), key=repr)
    for a, b in zip(g, w):
        if a != b:
            return f"{a} != {b}"
    return None
