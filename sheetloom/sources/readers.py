"""Rosters and images as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROSTER = "full_name string, aliases string, department string, phone string, email string"
LARGEST_IMAGE = 10 * 1024 * 1024
# fixed values: endings and first bytes of the image kinds that are taken
KINDS = {"image/jpeg": "FFD8FF", "image/png": "89504E470D0A1A0A", "image/webp": "52494646........57454250"}
ENDINGS = ("jpg", "jpeg", "png", "webp")
NO_IMAGE, TOO_LARGE = "not a JPEG, PNG or WebP image", "larger than 10 MB"


def read_roster(spark: SparkSession, path: str, schema: str = ROSTER) -> DataFrame:
    """CSV with a header; every value is text, quotes within one are doubled, and blank lines are skipped. Columns are matched to the header by name, so the
    order in the file is free; columns that the schema does not name are dropped, absent ones are null."""
    found = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    wanted = [f.strip().split(" ")[0] for f in schema.split(",")]
    return found.select(*(F.col(c) if c in found.columns else F.lit(None).cast("string").alias(c) for c in wanted))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content and kind (by first bytes; a dot stands for any digit), one row for each file."""
    return with_kind(spark.read.format("binaryFile").load(path))


def with_kind(files: DataFrame) -> DataFrame:
    head = F.hex(F.substring("content", 1, 12))
    kind = F.when(F.lit(False), "")
    for name, magic in KINDS.items():
        kind = kind.when(head.rlike(f"^{magic}"), name)
    return files.withColumn("kind", kind)


def guard_images(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images that are taken, and rejected ones with a reason; the kind is checked before the size."""
    reason = F.when(F.col("kind").isNull(), NO_IMAGE).when(F.col("length") > LARGEST_IMAGE, TOO_LARGE)
    judged = images.withColumn("reason", reason)
    return judged.filter("reason is null").drop("reason"), judged.filter("reason is not null")


def admit_images(spark: SparkSession, path: str, largest: int = LARGEST_IMAGE) -> tuple[DataFrame, DataFrame]:
    """Files of a folder (or a pattern) as images that are taken (path, length, content, kind) and rejected ones (path, length,
    reason). The size decides before any content is read: larger files are listed alone, so none of them can fail the job,
    and their kind is taken from the ending of the name; that of all others from their first bytes."""
    files = spark.read.format("binaryFile").load(path)
    fitting = with_kind(files.filter(F.col("length") <= largest))
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    large = files.filter(F.col("length") > largest).select("path", "length", F.when(ending.isin(*ENDINGS), TOO_LARGE).otherwise(NO_IMAGE).alias("reason"))
    taken = fitting.filter("kind is not null").select("path", "length", "content", "kind")
    return taken, fitting.filter("kind is null").select("path", "length", F.lit(NO_IMAGE).alias("reason")).unionByName(large)
