"""Joins in which one key holds most of the rows."""

import collections

import pytest
from pyspark.sql import functions as F

from sheetloom.llm.tables import SALTS, spread_join


@pytest.mark.parametrize("hint", [None, "merge"])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_spread_join_equals_a_plain_join(spark, how, hint):
    rows = spark.range(4000).select(F.when(F.col("id") % 10 < 7, 1).when(F.col("id") % 10 == 9, None).otherwise(F.col("id")).alias("k"), F.col("id").alias("at"))
    table = spark.createDataFrame([(1, "a"), (8, "b"), (18, "c"), (5000, "d"), (None, "e")], "k long, name string")
    got, want = spread_join(rows, table, ["k"], how, hint=hint), rows.join(table, "k", how)
    assert got.columns == want.columns
    seen = lambda df: collections.Counter(map(tuple, df.collect()))
    assert seen(got) == seen(want)
    if how == "inner":
        parts = got.select(F.pmod(F.xxhash64("k", "at"), F.lit(SALTS)).alias("salt")).distinct().count()
        assert parts == SALTS


def test_spread_join_without_rows(spark):
    rows = spark.createDataFrame([], "k long, at long")
    assert spread_join(rows, spark.createDataFrame([(1, "a")], "k long, name string"), ["k"]).count() == 0
