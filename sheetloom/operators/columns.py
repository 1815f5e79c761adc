"""Kinds of columns, from a header's label and then from sample cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all
from .rows import any_found

SAMPLES = 10
# fixed values: words of a designation, as substrings
DESIGNATION_WORDS = ["principal", "supervisor", "teacher", "assistant", "clerk", "officer", "manager", "director", "head", "staff", "lecturer", "tr."]
# fixed values: kind and pattern of the label, in the order in which they are tried
LABELS = [("serial", "sr|no|#|serial"), ("name", "name"), ("designation", "designation|role|position|title"), ("percentage", "%|percent"), ("date", "date|day"), ("status", "status|present|absent|lwp"), ("numeric", "total|working|balance|days|count")]
WORKSPACE_LABELS = [("serial", "sr|no|#|serial"), ("name", "name"), ("designation", "designation|role"), ("percentage", "%|percent"), ("numeric", "total|working|days|balance|absent|present|lwp|ott"), ("status", "status")]
# fixed values: shapes of single cells
SERIAL, PERCENTAGE, DATE = r"^[0-9]{1,3}\.?$", r"^[0-9]{1,3}(\.[0-9]+)?%?$", r"[0-9]{1,2}[/.-][0-9]{1,2}([/.-][0-9]{2,4})?"
NUMBER, FULL_NAME, WHOLE = r"^[0-9]+(\.[0-9]+)?$", r"^[A-Z][a-z]+(\s[A-Z][a-z]+)+", r"^[0-9]+$"


def by_label(label: Column, labels: list[tuple[str, str]]) -> Column:
    out = F.when(F.lower(label).rlike(labels[0][1]), labels[0][0])
    for kind, pattern in labels[1:]:
        out = out.when(F.lower(label).rlike(pattern), kind)
    return out


def kind_of(label: Column, samples: Column) -> Column:
    """The label decides, else the sample cells do."""
    n = F.size(samples)
    share = lambda test, cells=samples: F.size(F.filter(cells, test)) / n
    return F.coalesce(
        by_label(label, LABELS),
        F.when(n == 0, "unknown").when(share(lambda c: trim_all(c).rlike(NUMBER)) > 0.7, "numeric").when(share(lambda c: trim_all(c).rlike(FULL_NAME)) > 0.4, "name")
        .when(share(lambda c: any_found(c, DESIGNATION_WORDS), F.transform(samples, F.lower)) > 0.4, "designation").otherwise("text"),
    )


def shape(cell: Column) -> Column:
    """What a single cell looks like: serial, numeric, percentage, date or name; null for none of these."""
    text = trim_all(cell)
    return F.when(text.rlike(SERIAL), "serial").when(text.rlike(NUMBER), "numeric").when(text.rlike(PERCENTAGE), "percentage").when(text.rlike(DATE), "date").when(text.rlike(FULL_NAME), "name")


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("doc_id", "row_idx", F.posexplode("columns").alias("col_idx", "cell"))


def _labels(headers: DataFrame, widths: DataFrame) -> DataFrame:
    """The cell of the first header row, else Col n, for every column."""
    first = headers.groupBy("doc_id").agg(F.min_by("columns", "row_idx").alias("header"))
    every = widths.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col_idx"))
    label = F.coalesce(F.get("header", F.col("col_idx")), F.concat(F.lit("Col "), (F.col("col_idx") + 1).cast("string")))
    return every.join(first, "doc_id", "left").select("doc_id", "col_idx", label.alias("label"))


def infer_schema(classified: DataFrame) -> DataFrame:
    """Kind, label, confidence and samples of every column of each document of classified rows: the label decides, else the
    first SAMPLES cells that are not blank do. Rows are read once and stay with their document: the first row stands for
    columns that have no cells."""
    table = F.col("region").isin("header", "data")
    doc = Window.partitionBy("doc_id")
    rows = classified.select(
        "doc_id", "row_idx", "columns", (F.col("region") == "data").alias("is_data"),
        (F.col("row_idx") == F.min(F.when(F.col("region") == "header", F.col("row_idx"))).over(doc)).alias("is_label"),
        F.greatest(F.coalesce(F.max(F.when(table, F.size("columns"))).over(doc), F.lit(1)), F.lit(1)).alias("width"),
        (F.row_number().over(doc.orderBy("row_idx")) == 1).alias("is_first"),
    )
    rows = rows.filter("is_data or is_label or is_first")
    own = F.least(F.size("columns"), F.col("width"))
    cells = rows.withColumn("col_idx", F.explode(F.sequence(F.lit(0), F.when(F.col("is_first"), F.col("width")).otherwise(own) - 1, F.lit(1)))).withColumn("cell", F.get("columns", F.col("col_idx")))
    full = F.col("is_data") & (trim_all("cell") != "")
    found = cells.groupBy("doc_id", "col_idx").agg(
        F.max(F.when(F.col("is_label"), F.col("cell"))).alias("label"), F.slice(F.array_sort(F.collect_list(F.when(full, F.struct("row_idx", "cell")))), 1, SAMPLES).alias("samples")
    )
    found = found.select("doc_id", "col_idx", F.coalesce("label", F.concat(F.lit("Col "), (F.col("col_idx") + 1).cast("string"))).alias("label"), F.transform("samples", lambda s: s["cell"]).alias("samples"))
    kind = kind_of(F.col("label"), F.col("samples"))
    return found.select("doc_id", "col_idx", kind.alias("kind"), "label", F.when(F.size("samples") > 3, 80).otherwise(50).alias("confidence"), "samples")


def workspace_schema(rows: DataFrame) -> DataFrame:
    """The other rule, of the workspace: its own labels, then the share of whole numbers in all cells that are not empty."""
    header = F.coalesce("is_header", F.lit(False))
    widths = rows.groupBy("doc_id").agg(F.greatest(F.max(F.size("columns")), F.lit(1)).alias("width"))
    labels = _labels(rows.filter(header), widths)
    samples = _cells(rows.filter(~header)).filter(F.col("cell") != "").groupBy("doc_id", "col_idx").agg(F.count("*").alias("n"), F.avg(trim_all("cell").rlike(WHOLE).cast("int")).alias("whole"))
    kind = F.coalesce(by_label(F.col("label"), WORKSPACE_LABELS), F.when(F.col("whole") > 0.7, "numeric").when(F.col("n") > 0, "text").otherwise("unknown"))
    return labels.join(samples, ["doc_id", "col_idx"], "left").select("doc_id", "col_idx", "label", kind.alias("kind"))
