"""Grids in scanned sheets: ink, projections, boundaries, cells and components.

pixels: img_id, y, x, and r, g, b or v (1 for ink). Projections and boundaries are windows and sums over these; connected
components need the whole image and run on each image's rows in numpy.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

INK, INK_INVERTED = 160, 100


def luma():
    return 0.2126 * F.col("r") + 0.7152 * F.col("g") + 0.0722 * F.col("b")


def binarize(pixels: DataFrame, inverted: bool = False) -> DataFrame:
    """v: 1 where the luma is below INK, or above INK_INVERTED for light ink."""
    ink = luma() > INK_INVERTED if inverted else luma() < INK
    return pixels.withColumn("v", ink.cast("int")).drop("r", "g", "b")


def sizes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("img_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))


def projection(pixels: DataFrame, axis: str = "y") -> DataFrame:
    """Share of ink of each line of pixels, in single precision as it is compared."""
    across = "w" if axis == "y" else "h"
    sums = pixels.groupBy("img_id", F.col(axis).alias("at")).agg(F.sum("v").alias("ink"))
    return sums.join(sizes(pixels), "img_id").select("img_id", "at", (F.col("ink") / F.col(across)).cast("float").alias("share"), F.col("h" if axis == "y" else "w").alias("size"))


def boundaries(profile: DataFrame, threshold: float, least_gap: int | Column) -> DataFrame:
    """profile: img_id, at, share, size (and the column of least_gap, one value an image). 0, the middle of each gap of at least `least_gap` lines at or below the threshold
    that ink ends, and the last line. Gaps are runs: the position less the number of gap lines so far is one value. The middle
    of a gap of one line before the last one is the last line itself, and then stands twice."""
    order = Window.partitionBy("img_id").orderBy("at")
    gap = F.col("share") <= F.lit(threshold)
    profile = profile.withColumn("least", least_gap if isinstance(least_gap, Column) else F.lit(least_gap))
    runs = profile.withColumn("gap", gap).withColumn("run", F.col("at") - F.count_if("gap").over(order)).withColumn("last", F.max("at").over(Window.partitionBy("img_id")))
    runs = runs.groupBy("img_id", "gap", F.when(F.col("gap"), F.col("run")).alias("run")).agg(
        F.min("at").alias("a"), F.max("at").alias("b"), *(F.any_value(c).alias(c) for c in ("last", "least", "size"))
    )
    wide = F.col("gap") & (F.col("b") < F.col("last")) & (F.col("b") - F.col("a") + 1 >= F.col("least"))
    middle = F.when(wide, F.array(F.floor((F.col("a") + F.col("b") + 1) / 2 + 0.5).cast("int")))
    ends = F.when(F.col("b") == F.col("last"), F.array(F.lit(0), F.col("size") - 1))  # one run of an image holds its last line
    return runs.select("img_id", F.explode(F.coalesce(middle, ends)).alias("at"))


def scaled_gap(pixels: int, scale: float) -> int:
    return max(3, int(pixels / scale + 0.5))


def intervals(bounds: DataFrame) -> DataFrame:
    order = Window.partitionBy("img_id").orderBy("at")
    out = bounds.withColumn("next", F.lead("at").over(order)).withColumn("idx", F.row_number().over(order) - 1)
    return out.filter("next is not null").select("img_id", "idx", F.col("at").alias("low"), F.col("next").alias("high"))


def cells(rows: DataFrame, columns: DataFrame, padding: int = 3, least: int = 20) -> DataFrame:
    """Every row interval with every column interval of an image: a rectangle within the padding."""
    y = intervals(rows).select("img_id", F.col("idx").alias("row_idx"), F.col("low").alias("y0"), F.col("high").alias("y1"))
    x = intervals(columns).select("img_id", F.col("idx").alias("col_idx"), F.col("low").alias("x0"), F.col("high").alias("x1"))
    size = lambda a, b: F.greatest(F.lit(least), F.col(b) - F.col(a) - 2 * padding)
    return y.join(x, "img_id").select("img_id", "row_idx", "col_idx", (F.col("x0") + padding).alias("x"), (F.col("y0") + padding).alias("y"), size("x0", "x1").alias("w"), size("y0", "y1").alias("h"))


def fit(width, height, longest: int):
    """Size after shrinking so that the longest side is at most `longest`; never enlarged."""
    scale = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return F.floor(width * scale + 0.5).cast("int"), F.floor(height * scale + 0.5).cast("int")


def components_of(ink: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """x, y, w, h and area of each 4-connected part, in the order in which rows meet them. Labels sink to the least of their
    neighbours, by runs along rows and columns, until none changes."""
    h, w = ink.shape
    label = np.where(ink, np.arange(h * w).reshape(h, w), h * w)
    while True:
        now = label.copy()
        for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
            now[a] = np.where(ink[a], np.minimum(now[a], now[b]), now[a])
            now[:, a] = np.where(ink[:, a], np.minimum(now[:, a], now[:, b]), now[:, a])
        flat = np.append(now.ravel(), h * w)
        now = np.where(ink, flat[now], now)  # a label's own label
        if (now == label).all():
            break
        label = now
    y, x = np.nonzero(ink)
    parts = pd.DataFrame({"label": label[y, x], "y": y, "x": x}).groupby("label", sort=True)
    box = parts.agg(x0=("x", "min"), x1=("x", "max"), y0=("y", "min"), y1=("y", "max"), area=("x", "size"))
    return [(int(r.x0), int(r.y0), int(r.x1 - r.x0 + 1), int(r.y1 - r.y0 + 1), int(r.area)) for r in box.itertuples()]


def connected_components(pixels: DataFrame) -> DataFrame:
    def each(rows: pd.DataFrame) -> pd.DataFrame:
        ink = np.zeros((rows["y"].max() + 1, rows["x"].max() + 1), bool)
        ink[rows["y"], rows["x"]] = rows["v"] == 1
        out = pd.DataFrame(components_of(ink), columns=["x", "y", "w", "h", "area"])
        out.insert(0, "part", range(len(out)))
        out.insert(0, "img_id", rows["img_id"].iloc[0])
        return out

    kind = pixels.schema["img_id"].dataType.simpleString()
    return pixels.select("img_id", "y", "x", "v").groupBy("img_id").applyInPandas(each, f"img_id {kind}, part int, x int, y int, w int, h int, area int")


def density(pixels: DataFrame, parts: DataFrame, least_ink: float = 0.005) -> DataFrame:
    """Whether an image of a cell is empty: too little ink, or parts that are all specks, lines or borders."""
    ink = pixels.groupBy("img_id").agg(F.avg("v").alias("ratio"), (F.max("x") + 1).alias("iw"), (F.max("y") + 1).alias("ih"))
    aspect = F.col("w") / F.col("h")
    edge = (F.col("x") <= 2) | (F.col("y") <= 2) | (F.col("x") + F.col("w") >= F.col("iw") - 2) | (F.col("y") + F.col("h") >= F.col("ih") - 2)
    border = edge & ((F.col("w") > 0.8 * F.col("iw")) | (F.col("h") > 0.8 * F.col("ih")))
    kept = (F.col("area") >= 8) & aspect.between(0.1, 10) & ~border
    counted = parts.join(ink, "img_id").groupBy("img_id").agg(F.count("*").alias("n"), F.count_if(kept).alias("kept"))
    few, none = F.col("ratio") < least_ink, F.coalesce("kept", F.lit(0)) == 0
    return ink.join(counted, "img_id", "left").select(
        "img_id",
        (few | none).alias("is_empty"),
        "ratio",
        F.when(few, 0).when(none, F.coalesce("n", F.lit(0))).otherwise(F.col("kept")).alias("n_parts"),
        F.when(few, "Zero ink detected").when(none, "Only noise or borders detected").alias("reason"),
    )


def preprocess(pixels: DataFrame, brightness: float = 0.0, contrast: float = 0.0, threshold: int | None = None, grayscale: bool = True, sharpen: bool = False) -> DataFrame:
    """Channels r, g, b (0 to 255): gray, unless `grayscale` is off, then brightness (-1 to 1, of 255) and contrast about 128
    (-1 to 1: a factor of 0 to 2), an optional threshold on red, and an optional 3 by 3 sharpening of each channel with zeros
    around the image. After the first step and the last, values are cut to the range and rounded to 8 bits, halves to even."""
    bits = lambda v: F.rint(F.greatest(F.lit(0.0), F.least(F.lit(255.0), v)))
    value = lambda v: bits((v + brightness * 255 - 128) * (contrast + 1) + 128)
    gray = luma()
    out = pixels.select("img_id", "y", "x", *(value(gray if grayscale else F.col(c).cast("double")).alias(c) for c in "rgb"))
    if threshold is not None:
        black = F.when(F.col("r") > threshold, 255.0).otherwise(0.0)
        out = out.select("img_id", "y", "x", *(black.alias(c) for c in "rgb"))
    if sharpen:
        row, column = Window.partitionBy("img_id", "y").orderBy("x"), Window.partitionBy("img_id", "x").orderBy("y")
        beside = lambda c: [F.coalesce(f(c).over(w), F.lit(0.0)) for w in (row, column) for f in (F.lag, F.lead)]
        out = out.select("img_id", "y", "x", *(bits(5 * F.col(c) - sum(beside(c), F.lit(0.0))).alias(c) for c in "rgb"))
    return out.select("img_id", "y", "x", *(F.col(c).cast("int").alias(c) for c in "rgb"))


def crop(pixels: DataFrame, boxes: DataFrame, scale: int = 3, dark: int = 140, inverted: bool = False) -> DataFrame:
    """The pixels (r, g, b) of each cell, each repeated scale by scale times: img_id, row_idx, col_idx, y, x and v, which is 1
    for dark ones, or for light ones of an inverted image. Cells and pixels of an image meet on its rows of pixels."""
    rows = boxes.withColumn("py", F.explode(F.sequence(F.col("y"), F.col("y") + F.col("h") - 1)))
    p = pixels.select("img_id", F.col("y").alias("py"), F.col("x").alias("px"), luma().alias("g"))
    inside = rows.join(p, ["img_id", "py"]).filter((F.col("px") >= F.col("x")) & (F.col("px") < F.col("x") + F.col("w")))
    ink = (255 - F.col("g") if inverted else F.col("g")) < dark
    steps = F.sequence(F.lit(0), F.lit(scale - 1))
    big = inside.select("img_id", "row_idx", "col_idx", F.explode(steps).alias("dy"), ((F.col("py") - F.col("y")) * scale).alias("y0"), ((F.col("px") - F.col("x")) * scale).alias("x0"), ink.cast("int").alias("v"))
    return big.select("img_id", "row_idx", "col_idx", (F.col("y0") + F.col("dy")).alias("y"), F.explode(steps).alias("dx"), "x0", "v").select("img_id", "row_idx", "col_idx", "y", (F.col("x0") + F.col("dx")).alias("x"), "v")
