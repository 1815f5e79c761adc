"""Counts, shares and progress of sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import round_half_up


def table_counts(**tables: DataFrame) -> DataFrame:
    """name and n of each table; one column-free scan each."""
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def session_kpis(rows: DataFrame) -> DataFrame:
    """rows: session_id, status, raw_override, is_header, member_id, ocr_confidence, columns. One pass for all measures."""
    header = F.coalesce("is_header", F.lit(False))
    override = F.coalesce(F.col("raw_override") != "", F.lit(False))
    return rows.groupBy("session_id").agg(
        F.count("*").alias("n_rows"),
        F.count_if((F.col("status") == "correction") | override).alias("n_edits"),
        F.count_if(F.col("status") == "flagged").alias("n_flagged"),
        F.count_if(header).alias("n_headers"),
        F.count_if(~header & F.col("member_id").isNotNull()).alias("n_identified"),
        F.count_if(~header & F.col("member_id").isNull()).alias("n_unknown"),
        round_half_up(100 * F.avg((F.coalesce("ocr_confidence", F.lit(0.0)) > 80).cast("int"))).alias("quality_index"),
        F.coalesce(100 * F.avg((F.col("status") == "approved").cast("int")), F.lit(0.0)).alias("progress"),
        F.greatest(F.coalesce(F.max(F.size("columns")), F.lit(1)), F.lit(1)).alias("max_columns"),
    )


def row_counts(sessions: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of each session, 0 for those without."""
    n = rows.groupBy(F.col("session_id").alias("id")).agg(F.count("*").alias("n_rows"))
    return sessions.select("id").join(n, "id", "left").select("id", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))
