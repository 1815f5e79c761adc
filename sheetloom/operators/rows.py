"""Rows of recognised tables: padding, validating, classifying, merging headers, and summaries of documents.

Rows carry doc_id and row_idx; order is never taken from a DataFrame. Windows are over one document.
"""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import BLANKS, clean_cell, col, trim_all

# fixed values: words that mark a region, as substrings of the lower-case text
HEADER_WORDS = ["sr", "no", "name", "designation", "total", "working", "days", "present", "absent", "half", "holiday", "sunday", "balance", "lwp", "full", "register", "summary", "day", "c.l", "s.l", "ott", "sce"]
TITLE_WORDS = ["register", "attendance", "summary", "report", "sheet", "record", "yearly", "monthly", "quarterly", "school", "department", "company"]
METADATA_WORDS = ["date", "prepared", "by", "approved", "department", "year", "month", "www.", "http", "@", ".com", ".org", "info"]
FOOTER_WORDS = ["total", "grand", "average", "sum"]
# fixed values: issues of rows, explanations of regions
MISSING, EXTRA = ("Missing ", " column(s) — padding with empty cells"), ("Extra ", " column(s) — likely merged cell or OCR split")
NOISE = "Row appears to be visual noise or separator line"
EMPTY, TITLE, METADATA_ABOVE, METADATA = "No text content detected", "Contains title keyword in top region", "Contains metadata pattern", "Matches metadata pattern"
HEADER, MARKED_HEADER, FOOTER, DATA = " header keywords detected", "Geometric header + 1 keyword", "Summary row in footer region", "Default data row classification"
MERGED = "Merged fragmented header rows"


def words_found(text: Column, words: list[str]) -> Column:
    """How many of the words the text contains."""
    return reduce(add, (F.contains(text, F.lit(w)).cast("int") for w in words))


def any_found(text: Column, words: list[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def all_blank(columns: Column | str) -> Column:
    return F.forall(col(columns), lambda x: F.ltrim(x, F.lit(BLANKS)) == "")


def drop_blank_rows(rows: DataFrame) -> DataFrame:
    return rows.filter(~all_blank("columns"))


def pad(columns: Column | str, n: Column) -> Column:
    """The first n cells, with empty ones for those that lack."""
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.coalesce(F.get(col(columns), i), F.lit("")))


def validate_row(rows: DataFrame, expected: Column, kinds: Column | None = None) -> DataFrame:
    """Adds corrected, issues and is_valid. Short rows are padded, cells too many are joined into the last one, every cell
    is cleaned by the kind of its column, and rows whose cells have one character at most are noise."""
    size, columns = F.size("columns"), F.col("columns")
    joined = F.concat(F.slice(columns, F.lit(1), expected - 1), F.array(F.array_join(F.slice(columns, expected, F.greatest(size - expected + 1, F.lit(0))), " ")))
    fitted = F.when(size < expected, F.concat(columns, F.array_repeat(F.lit(""), expected - size))).when((size > expected) & (expected > 0), joined).otherwise(columns)
    cleaned = F.transform(fitted, lambda x, i: clean_cell(x, F.get(kinds, i) if kinds is not None else F.lit(None).cast("string")))
    out = rows.withColumn("corrected", cleaned)
    noise = F.forall("corrected", lambda x: F.length(trim_all(x)) <= 1)
    issues = F.array_compact(
        F.array(
            F.when(size < expected, F.concat(F.lit(MISSING[0]), (expected - size).cast("string"), F.lit(MISSING[1]))).when(
                (size > expected) & (expected > 0), F.concat(F.lit(EXTRA[0]), (size - expected).cast("string"), F.lit(EXTRA[1]))
            ),
            F.when(noise, F.lit(NOISE)),
        )
    )
    return out.withColumn("issues", issues).withColumn("is_valid", F.size("issues") == 0)


def validate_documents(rows: DataFrame) -> DataFrame:
    """For each document, over rows that are no headers: the most frequent number of cells (the smallest of equals), the
    positions of other rows, whether they are few, and a grade."""
    data = rows.filter(~F.coalesce("is_header", F.lit(False))).withColumn("width", F.size("columns"))
    data = data.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("row_idx")) - 1)
    common = data.groupBy("doc_id", "width").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.min(F.struct((-F.col("n")).alias("less"), "width")).alias("top"), F.sum("n").alias("n"))
    odd = F.col("width") != F.col("top.width")
    found = (
        data.join(common, "doc_id")
        .groupBy("doc_id")
        .agg(F.any_value("top.width").alias("dominant"), F.any_value("n").alias("n"), F.array_sort(F.collect_list(F.when(odd, F.col("at")))).alias("outliers"))
    )
    share = F.size("outliers") / F.col("n")
    every = rows.select("doc_id").distinct().join(found, "doc_id", "left")
    return every.select(
        "doc_id",
        F.coalesce(share < 0.15, F.lit(True)).alias("consistent"),
        F.coalesce("dominant", F.lit(0)).alias("dominant"),
        F.coalesce("outliers", F.array().cast("array<int>")).alias("outliers"),
        F.when(F.size("outliers") == 0, "high").when(share < 0.3, "medium").otherwise("low").alias("quality"),
    )


def classify(rows: DataFrame, alone: bool = False, width: Column | None = None) -> DataFrame:
    """Adds region, region_confidence and explanation. Needs text, columns, is_header; a document's rows are counted by a
    window of the document, unless each row stands `alone` as a document of its own. width: of rows whose columns leave out
    what is empty at their end."""
    out = rows.withColumn("n_rows", F.lit(1) if alone else F.count("*").over(Window.partitionBy("doc_id"))).withColumn("lower", F.lower(trim_all("text")))
    lower, few = F.col("lower"), (F.size("columns") if width is None else width) <= 2
    meta, footer = any_found(lower, METADATA_WORDS), any_found(lower, FOOTER_WORDS)
    out = out.withColumn("header_words", words_found(lower, HEADER_WORDS))
    top, heads = F.col("row_idx") < 4, F.col("header_words")
    cases = [
        ((lower == "") | all_blank("columns"), "empty", 99, F.lit(EMPTY)),
        (top & few & any_found(lower, TITLE_WORDS), "title", 90, F.lit(TITLE)),
        (top & few & meta, "metadata", 85, F.lit(METADATA_ABOVE)),
        (few & meta, "metadata", 80, F.lit(METADATA)),
        (heads >= 2, "header", 90, F.concat(heads.cast("string"), F.lit(HEADER))),
        (F.coalesce("is_header", F.lit(False)) & (heads >= 1), "header", 75, F.lit(MARKED_HEADER)),
        ((F.col("row_idx") > F.col("n_rows") * 0.85) & footer, "footer", 80, F.lit(FOOTER)),
    ]
    picked = F.when(cases[0][0], 0)
    for k, case in enumerate(cases[1:], 1):
        picked = picked.when(case[0], k)
    out = out.withColumn("case", picked.otherwise(len(cases)))

    def pick(i: int, otherwise) -> Column:
        value = F.when(F.col("case") == 0, cases[0][i])
        for k, case in enumerate(cases[1:], 1):
            value = value.when(F.col("case") == k, case[i])
        return value.otherwise(otherwise)

    return out.withColumn("region", pick(1, "data")).withColumn("region_confidence", pick(2, 70)).withColumn("explanation", pick(3, DATA)).drop("case", "header_words", "n_rows", "lower")


def merge_headers(rows: DataFrame, near: float = 20.0) -> DataFrame:
    """Header rows that follow each other within `near` pixels are joined in pairs, cell by cell, from the top: in a run of
    such rows the odd ones join those above them. Needs region and bbox; an explanation says that rows were merged."""
    w = Window.partitionBy("doc_id").orderBy("row_idx")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    close = (F.col("region") == "header") & (F.lag("region").over(w) == "header") & (F.abs(F.col("bbox.y0") - F.lag("bbox.y1").over(w)) < near)
    out = rows.withColumn("joins", F.coalesce(close, F.lit(False))).withColumn("at", F.row_number().over(w))
    out = out.withColumn("at", F.col("at") - F.max(F.when(~F.col("joins"), F.col("at"))).over(so_far))
    out = out.withColumn("under", F.when(F.lead("joins").over(w) & (F.col("region") == "header"), F.lead("columns").over(w))).filter(F.col("at") % 2 == 0)
    joined, under = F.col("under").isNotNull(), F.col("under")
    merged = F.transform("columns", lambda c, i: F.when(F.coalesce(F.get(under, i), F.lit("")) != "", trim_all(F.concat(c, F.lit(" "), F.get(under, i)))).otherwise(c))
    out = out.withColumn("columns", F.when(joined, merged).otherwise(F.col("columns")))
    out = out.withColumn("text", F.when(joined, F.array_join("columns", "  ")).otherwise(F.col("text")))
    if "explanation" in rows.columns:
        out = out.withColumn("explanation", F.when(joined, MERGED).otherwise(F.col("explanation")))
    return out.drop("joins", "at", "under")


def summarise(rows: DataFrame) -> DataFrame:
    """One row for each document of classified rows: table bounds, title, metadata and overall confidence."""
    table = F.col("region").isin("header", "data")
    ordered = lambda region: F.transform(F.array_sort(F.collect_list(F.when(F.col("region") == region, F.struct("row_idx", "text")))), lambda s: s["text"])
    data = F.coalesce(F.avg(F.when(F.col("region") == "data", F.col("confidence"))), F.lit(0.0))
    return rows.groupBy("doc_id").agg(
        F.coalesce(F.min(F.when(table, F.col("row_idx"))), F.lit(0)).alias("table_start"),
        F.coalesce(F.max(F.when(table, F.col("row_idx"))), F.max("row_idx")).alias("table_end"),
        F.array_join(ordered("title"), " ").alias("title"),
        ordered("metadata").alias("metadata"),
        ((data + F.when(F.count_if(table) > 3, 80).otherwise(50)) / 2).alias("overall_confidence"),
    )
