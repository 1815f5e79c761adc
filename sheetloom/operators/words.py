"""Rows and columns from single words with boxes, for sheets without a grid."""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import trim_all

LEAST_APART, SHARE_APART, GAP = 14.0, 0.45, 1.5
# fixed values: words that mark a header row
HEADER_HINTS = ["name", "sr", "designation", "total", "present", "register"]


def cluster_rows(words: DataFrame) -> DataFrame:
    """words: doc_id, word_ord, text, confidence, x0, y0, x1, y1. Adds row_idx, row_y and row_height.

    Words join, in order, the first row whose mean middle is close enough to theirs, and shift that mean. The outcome hangs
    on the order and on all words before, so each document is folded in turn. Documents stream through a task, and a word
    looks at the rows near it alone."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        """Whole documents, one after another."""
        row_idx, row_y, row_height = [], [], []
        codes, y0s, y1s = pd.factorize(rows["doc_id"], use_na_sentinel=False)[0].tolist(), rows["y0"].tolist(), rows["y1"].tolist()
        begin = 0
        while begin < len(codes):
            end = bisect_right(codes, codes[begin], begin)
            means, heights, member = _rows_of(y0s[begin:end], y1s[begin:end])
            rank = pd.Series(means).rank(method="first").tolist()
            row_idx += [int(rank[k]) - 1 for k in member]
            row_y += [means[k] for k in member]
            row_height += [heights[k] for k in member]
            begin = end
        return rows.assign(row_idx=row_idx, row_y=row_y, row_height=row_height)

    def stream(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = []  # parts of the last document, which may go on
        for part in parts:
            if part.empty:
                continue
            codes = pd.factorize(part["doc_id"], use_na_sentinel=False)[0]
            same = bool(held) and (held[0]["doc_id"].iloc[0] == part["doc_id"].iloc[0] or bool(pd.isna(held[0]["doc_id"].iloc[0]) and pd.isna(part["doc_id"].iloc[0])))
            if same and codes[-1] == 0:
                held.append(part)
                continue
            last = codes == codes[-1]
            if held or not last.all():
                yield fold(pd.concat([*held, part[~last]], ignore_index=True))
            held = [part[last]]
        if held:
            yield fold(pd.concat(held, ignore_index=True))

    schema = words.withColumns({"row_idx": F.lit(0), "row_y": F.lit(0.0), "row_height": F.lit(0.0)}).schema
    return words.repartition("doc_id").sortWithinPartitions("doc_id", "word_ord").mapInPandas(stream, schema)


def _rows_of(y0s: list[float], y1s: list[float]) -> tuple[list[float], list[float], list[int]]:
    """Mean middle and height of each row of a document in the order of their first words, and the row of each word. Rows
    are found by the strip of LEAST_APART that holds their mean."""
    means, counts, heights, member, strips = [], [], [], [], {}
    for y0, y1 in zip(y0s, y1s, strict=True):
        middle, height = (y0 + y1) / 2, y1 - y0
        reach = max(LEAST_APART, SHARE_APART * height)
        at = None
        if math.isfinite(middle):
            low, high = math.floor((middle - reach) / LEAST_APART) - 1, math.floor((middle + reach) / LEAST_APART) + 1
            near = (k for s in range(low, high + 1) for k in strips.get(s, ())) if high - low < len(means) else range(len(means))
            at = min((k for k in near if abs(means[k] - middle) < reach), default=None)
        if at is None:
            at = len(means)
            means.append(middle)
            counts.append(1)
            heights.append(height)
        else:
            strips[math.floor(means[at] / LEAST_APART)].discard(at)
            means[at] = (means[at] * counts[at] + middle) / (counts[at] + 1)
            counts[at] += 1
            heights[at] = max(heights[at], height)
        if math.isfinite(means[at]):
            strips.setdefault(math.floor(means[at] / LEAST_APART), set()).add(at)
        member.append(at)
    return means, heights, member


def split_columns(words: DataFrame) -> DataFrame:
    """Words of a row, from left to right, part into cells where a gap exceeds GAP times the row's height. Returns a row of
    columns, text, confidences, is_header and bbox for each row that holds text."""
    order = Window.partitionBy("doc_id", "row_idx").orderBy("x0", "word_ord")
    gap = F.col("x0") - F.lag("x1").over(order)
    words = words.withColumn("col_idx", F.count_if(F.coalesce(gap > GAP * F.col("row_height"), F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x0", "word_ord", "text"))), lambda s: s["text"]), " ")
    middle = (F.col("y0") + F.col("y1")) / 2
    cells = words.groupBy("doc_id", "row_idx", "col_idx").agg(
        text.alias("cell"),
        F.count("*").alias("n"),
        F.sum("confidence").alias("confidence"),
        F.sum(F.abs(middle - F.col("row_y"))).alias("off"),
        *(f(c).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))),
    )
    clean = trim_all(F.regexp_replace(F.regexp_replace(trim_all("cell"), r"^[\[|]+", ""), r"[\]|]+$", ""))
    rows = cells.groupBy("doc_id", "row_idx").agg(
        F.filter(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", clean.alias("cell")))), lambda s: s["cell"]), lambda c: c != "").alias("columns"),
        (F.sum("confidence") / F.sum("n")).alias("confidence"),
        (F.sum("off") / F.sum("n")).alias("off"),
        F.struct(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).alias("bbox"),
    )
    row, column = F.greatest(F.lit(0.0), 100 - 5 * F.col("off")), F.when(F.size("columns") > 1, 75.0).otherwise(50.0)
    hint = F.exists("columns", lambda c: F.exists(F.array(*(F.lit(w) for w in HEADER_HINTS)), lambda w: F.contains(F.lower(c), w)))
    return rows.filter(F.size("columns") > 0).select(
        "doc_id", "row_idx", F.array_join("columns", "  ").alias("text"), "columns", "confidence",
        F.struct(row.alias("row"), column.alias("column"), ((row + column + F.col("confidence")) / 3).alias("total")).alias("structural"),
        ((F.col("row_idx") < 2) | hint).alias("is_header"), "bbox",
    )
