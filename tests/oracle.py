"""Rows of a DataFrame and of DuckDB's SQL over the same tables, made comparable."""

from __future__ import annotations

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _value(v):
    if v is None or str(v) == "<NA>" or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(list(v)) if hasattr(v, "tolist") and getattr(v, "ndim", 0) else str(v)


def rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(_value(v.item() if hasattr(v, "item") and not getattr(v, "ndim", 0) else v) for v in r) for r in pdf.itertuples(index=False))


def sql(query: str, data: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{data}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con.sql(query).df()
