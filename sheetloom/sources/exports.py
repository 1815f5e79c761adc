"""Tables of sessions as text: lines in row order within each session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(cell: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(cell, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def _data(rows: DataFrame) -> DataFrame:
    """No headers, titles or footers, and no rows without cells; a row without a region passes."""
    region = F.coalesce("region", F.lit(""))
    return rows.filter(~F.coalesce("is_header", F.lit(False)) & ~region.isin("title", "footer") & F.col("columns").isNotNull())


def _joined(lines: DataFrame, name: str) -> DataFrame:
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"])
    return lines.groupBy("session_id").agg(F.array_join(F.transform(ordered, lambda x: F.concat(x, F.lit("\n"))), "").alias(name))


def _lines(rows: DataFrame, line) -> DataFrame:
    """The cells of the first header row, if it has any, then the data rows, each made text by `line`."""
    head = rows.filter(F.coalesce("is_header", F.lit(False))).groupBy("session_id").agg(F.min_by("columns", "row_idx").alias("columns"))
    head = head.filter(F.size("columns") > 0).select("session_id", F.lit(-1).cast("long").alias("k"), line(F.col("columns")).alias("line"))
    return head.unionByName(_data(rows).select("session_id", F.col("row_idx").cast("long").alias("k"), line(F.col("columns")).alias("line")))


def to_csv(rows: DataFrame) -> DataFrame:
    """session_id and csv: header and data rows with every cell quoted; every line ends, the last one too."""
    return _joined(_lines(rows, lambda c: F.array_join(F.transform(c, quoted), ",")), "csv")


def to_tsv(rows: DataFrame) -> DataFrame:
    """session_id and tsv: header and data rows, cells as they are with tabs between (null ones empty); every line ends."""
    return _joined(_lines(rows, lambda c: F.array_join(c, "\t", "")), "tsv")


def letter(i: int) -> str:
    return chr(65 + i)


def to_wide(rows: DataFrame, width: int) -> DataFrame:
    """All rows with their cells in columns A, B, C and so on; a row without cells gives the name as read. The width is given,
    or found by an aggregate (see widest)."""
    cells = F.coalesce("columns", F.array("ocr_name"))
    return rows.select("session_id", "row_idx", *(F.get(cells, F.lit(i)).alias(letter(i)) for i in range(width)))


def widest(rows: DataFrame) -> int:
    return rows.agg(F.max(F.coalesce(F.size("columns"), F.lit(1)))).first()[0] or 1


def write_attendance(attendance: DataFrame, members: DataFrame, path: str) -> None:
    """CSV files with a header: the facts and the member's name."""
    named = attendance.join(members.select(F.col("id").alias("member_id"), F.col("full_name").alias("member_name")), "member_id", "left")
    named.write.mode("overwrite").option("header", True).csv(path)
