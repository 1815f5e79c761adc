"""Scan lines as words of 64 pixels: running windows, projections, runs and their components, and the grid of a scan.

words: img_id, y, k, bits (bit j is the pixel x = 64 k + j) and there (the pixels that the image has). A table has every word
of its images. Windows are over one line or one column of words, so that no image needs to fit into a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written
from .grid import INK, binarize, boundaries, cells

BITS = 64
#: The longest side of an image that is analysed; larger ones are shrunk.
LONGEST = 1000
#: Columns of an image whose runs meet in one step.
STRIP = 256


def pack(pixels: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """pixels: img_id, y, x, v. Words are put together before they are shuffled. Columns of `also` (one value an image) stay."""
    bit = F.expr("shiftleft(1L, cast(x % 64 as int))")
    ink = F.when(F.col("v") == 1, bit).otherwise(F.lit(0).cast("long"))
    return pixels.groupBy("img_id", "y", F.expr("cast(x div 64 as int)").alias("k")).agg(F.bit_or(ink).alias("bits"), F.bit_or(bit).alias("there"), *(F.max(c).alias(c) for c in also))


def unpack(words: DataFrame) -> DataFrame:
    """img_id, y, x and v of every pixel."""
    each = words.select("img_id", "y", "k", "bits", "there", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("j"))
    return each.filter("shiftright(there, j) & 1 = 1").select("img_id", "y", (F.col("k") * BITS + F.col("j")).cast("int").alias("x"), F.expr("cast(shiftright(bits, j) & 1 as int)").alias("v"))


def _across(words: DataFrame, reach: int, dilate: bool) -> DataFrame:
    """Bits of up to `reach` pixels to each side, joined by or, or by and; beyond the line there is no ink."""
    line = Window.partitionBy("img_id", "y").orderBy("k")
    while reach > 0:
        r = min(reach, BITS - 1)
        reach -= r
        with_both = words.withColumns({"low": F.coalesce(F.lag("bits").over(line), F.lit(0)), "high": F.coalesce(F.lead("bits").over(line), F.lit(0))})
        moved = [s for n in range(1, r + 1) for s in (f"(shiftleft(bits, {n}) | shiftrightunsigned(low, {BITS - n}))", f"(shiftrightunsigned(bits, {n}) | shiftleft(high, {BITS - n}))")]
        words = with_both.withColumn("bits", F.expr("(" + (" | " if dilate else " & ").join(["bits", *moved]) + ") & there")).drop("low", "high")
    return words


def _along(words: DataFrame, reach: int, dilate: bool) -> DataFrame:
    if not reach:
        return words
    column = Window.partitionBy("img_id", "k").orderBy("y").rangeBetween(-reach, reach)
    if dilate:
        return words.withColumn("bits", F.bit_or("bits").over(column).bitwiseAND(F.col("there")))
    whole = F.count("*").over(column) == 2 * reach + 1  # outside the image there is none
    return words.withColumn("bits", F.when(whole, F.bit_and("bits").over(column)).otherwise(F.lit(0).cast("long")))


def dilate(words: DataFrame, kx: int, ky: int) -> DataFrame:
    """Ink spreads to the rectangle of floor(k / 2) pixels to each side."""
    return _across(_along(words, ky // 2, True), kx // 2, True)


def erode(words: DataFrame, kx: int, ky: int) -> DataFrame:
    """Ink stays where the whole rectangle is ink; outside the image there is none."""
    return _across(_along(words, ky // 2, False), kx // 2, False)


def profile(words: DataFrame, axis: str) -> DataFrame:
    """img_id, at and ink: the pixels of ink of each line (axis y) or column (axis x)."""
    if axis == "y":
        return words.groupBy("img_id", F.col("y").alias("at")).agg(F.sum(F.bit_count("bits")).alias("ink"))
    counts = words.groupBy("img_id", "k").agg(F.bit_or("there").alias("there"), F.array(*(F.sum(F.expr(f"shiftright(bits, {j}) & 1")) for j in range(BITS))).alias("counts"))
    return counts.select("img_id", "k", "there", F.posexplode("counts").alias("j", "ink")).filter("shiftright(there, j) & 1 = 1").select("img_id", (F.col("k") * BITS + F.col("j")).cast("int").alias("at"), "ink")


def shrunk_size(w: Column, h: Column, longest: int = LONGEST) -> tuple[Column, Column, Column]:
    """Width, height and scale (1 or more) of an image whose longest side is `longest` at most."""
    large = F.greatest(w, h) > longest
    scale = F.when(large, F.greatest(w, h) / F.lit(longest)).otherwise(F.lit(1.0))
    side = lambda n, other: F.when(large & ((n > other) if other is h else (n >= other)), F.lit(longest)).otherwise(F.floor(n / scale + 0.5)).cast("int")
    return side(w, h), side(h, w), scale


def shrink(words: DataFrame, of: DataFrame) -> DataFrame:
    """Words of the shrunk images. of: img_id, sw, sh, scale. A shrunk pixel is the one that holds its middle; lines that hold
    none go before words are taken apart."""
    to = lambda c: F.ceil(F.col(c) / F.col("scale") - 0.5)
    held = lambda t, c: F.floor((F.col(t) + 0.5) * F.col("scale")) == F.col(c)
    lines = words.join(of, "img_id").withColumn("ty", to("y")).filter(held("ty", "y") & (F.col("ty") < F.col("sh")))
    each = lines.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1)))).filter("shiftright(there, j) & 1 = 1").withColumn("x", F.col("k") * BITS + F.col("j"))
    each = each.withColumn("tx", to("x")).filter(held("tx", "x") & (F.col("tx") < F.col("sw")))
    return pack(each.select("img_id", F.col("ty").cast("int").alias("y"), F.col("tx").cast("int").alias("x"), F.expr("shiftright(bits, j) & 1").alias("v")))


def pack_lines(lines: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Words of the shrunk and binarized images. lines: img_id, y, w, h, line (3 w bytes: red, green, blue). Each scan line is
    turned by itself."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ys, ks, bits, there = [], [], [], [], []
            for i, (y, w, h, line) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("y", "w", "h", "line")), strict=True)):
                scale = max(w, h) / longest if max(w, h) > longest else 1.0
                sw, sh = ((longest, math.floor(h / scale + 0.5)) if w > h else (math.floor(w / scale + 0.5), longest)) if scale > 1 else (w, h)
                at = math.ceil(y / scale - 0.5)
                if at >= sh or math.floor((at + 0.5) * scale) != y:
                    continue
                middle = np.floor((np.arange(sw) + 0.5) * scale).astype(int)
                rgb = np.frombuffer(line, np.uint8).reshape(w, 3)[middle].astype(float)
                dark = 0.2126 * rgb[:, 0] + 0.7152 * rgb[:, 1] + 0.0722 * rgb[:, 2] < INK
                n = -(-sw // BITS)
                for out, flags in ((bits, dark), (there, np.ones(sw, bool))):
                    out += np.packbits(np.pad(flags, (0, n * BITS - sw)), bitorder="little").view("<i8").tolist()
                ids += [i] * n
                ys += [at] * n
                ks += range(n)
            yield pa.RecordBatch.from_arrays([batch.column("img_id").take(pa.array(ids, pa.int64())), pa.array(ys, pa.int32()), pa.array(ks, pa.int32()), pa.array(bits, pa.int64()), pa.array(there, pa.int64())], ["img_id", "y", "k", "bits", "there"])

    return lines.select("img_id", "y", "w", "h", "line").mapInArrow(each, f"img_id {lines.schema['img_id'].dataType.simpleString()}, y int, k int, bits long, there long")


def bounds(words: DataFrame, of: DataFrame, axis: str, threshold: float, gap: int) -> DataFrame:
    """img_id and at: 0, the middles of gaps, and the last line or column of the shrunk image, scaled back."""
    across, along = ("sw", "sh") if axis == "y" else ("sh", "sw")
    shares = profile(words, axis).join(of, "img_id").select("img_id", "at", (F.col("ink") / F.col(across)).cast("float").alias("share"), F.col(along).alias("size"), F.greatest(F.lit(3), F.floor(gap / F.col("scale") + 0.5)).alias("least_gap"))
    found = boundaries(shares, threshold, F.col("least_gap"))
    return found.join(of.select("img_id", "scale"), "img_id").select("img_id", F.floor(F.col("at") * F.col("scale") + 0.5).cast("int").alias("at"))


def grid_of(words: DataFrame, of: DataFrame) -> DataFrame:
    """Cells of each image. words: of the shrunk images; of: img_id, sw, sh, scale. Ink is spread along lines for rows, and
    down columns for columns, before it is projected. Both read the words, which are written first."""
    words = written(words, "shrunk")
    rows = bounds(dilate(words, 20, 2), of, "y", 0.015, 8)
    columns = bounds(dilate(words, 2, 20), of, "x", 0.005, 10)
    return cells(rows, columns)


def segment(pixels: DataFrame) -> DataFrame:
    """From pixels (img_id, y, x, r, g, b; w and h too, if they are known) to cells: img_id, row_idx, col_idx, x, y, w, h.
    Images of no pixels have no cells. Pixels are read once, into written words, which give the sizes and are shrunk."""
    known = ("w", "h") if {"w", "h"} <= set(pixels.columns) else ()
    words = written(pack(binarize(pixels.select("img_id", "y", "x", "r", "g", "b", *known)), known), "words")
    last = F.col("k") * BITS + F.length(F.bin("there"))  # a word's last pixel is its highest bit
    size = words.groupBy("img_id").agg((F.max("w") if known else F.max(last)).alias("w"), (F.max("h") if known else F.max("y") + 1).alias("h"))
    sw, sh, scale = shrunk_size(F.col("w"), F.col("h"))
    of = written(size.select("img_id", sw.alias("sw"), sh.alias("sh"), scale.alias("scale")), "sizes")
    return grid_of(shrink(words.select("img_id", "y", "k", "bits", "there"), of), of)


def segment_lines(lines: DataFrame) -> DataFrame:
    """From scan lines (img_id, y, w, h, line) to cells."""
    sw, sh, scale = shrunk_size(F.col("w"), F.col("h"))
    of = written(lines.filter("y = 0").select("img_id", sw.alias("sw"), sh.alias("sh"), scale.alias("scale")), "sizes")
    return grid_of(pack_lines(lines), of)


def runs(words: DataFrame) -> DataFrame:
    """img_id, y, x0 and x1 of each unbroken run of ink in a line."""
    line = Window.partitionBy("img_id", "y").orderBy("k")
    edge = words.withColumns({"low": F.coalesce(F.lag("bits").over(line), F.lit(0)), "high": F.coalesce(F.lead("bits").over(line), F.lit(0))})
    edge = edge.filter("bits <> 0").select("img_id", "y", "k", F.expr("bits & ~(shiftleft(bits, 1) | shiftrightunsigned(low, 63))").alias("begin"), F.expr("bits & ~(shiftrightunsigned(bits, 1) | shiftleft(high, 63))").alias("end"))
    marks = edge.select("img_id", "y", "k", "begin", "end", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("j"), F.lit(None).cast("int").alias("x"))
    marks = marks.filter("shiftright(begin | end, j) & 1 = 1").select("img_id", "y", (F.col("k") * BITS + F.col("j")).alias("x"), F.expr("shiftright(begin, j) & 1 = 1").alias("is_begin"), F.expr("shiftright(end, j) & 1 = 1").alias("is_end"))
    after = Window.partitionBy("img_id", "y").orderBy("x")
    return marks.withColumn("x1", F.when(F.col("is_end"), F.col("x")).otherwise(F.lead("x").over(after))).filter("is_begin").select("img_id", "y", F.col("x").alias("x0"), "x1")


def least_reached(links: DataFrame) -> DataFrame:
    """links: img_id, u, v with v < u. img_id, u and the least v that u reaches, by alternating steps: each node's larger
    neighbours, then its smaller ones, are tied to its least one, until nothing moves. Steps are written tables."""
    links = written(links.distinct(), "links")
    before = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("img_id", "u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return links
        before = now
        both = links.unionByName(links.select("img_id", F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("img_id", "u").agg(F.min("v").alias("m")).select("img_id", "u", F.least("u", "m").alias("m"))
        large = both.join(least, ["img_id", "u"]).filter("v > u").select("img_id", F.col("v").alias("u"), F.col("m").alias("v"))
        small = large.groupBy("img_id", "u").agg(F.min("v").alias("m"))
        moved = large.join(small, ["img_id", "u"]).filter("v <> m").select("img_id", F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.select("img_id", "u", F.col("m").alias("v")).unionByName(moved).distinct(), "links")


def components(words: DataFrame) -> DataFrame:
    """img_id, part, x, y, w, h and area of each 4-connected part, in the order in which lines meet them. Runs of neighbouring
    lines are joined where they overlap, strip by strip of columns, and parts are found over runs, so an image may be larger
    than a task."""
    number = F.col("y").cast("long") * (1 << 31) + F.col("x0")
    all_runs = written(runs(words).withColumn("run", number), "runs")
    stripped = all_runs.withColumn("strip", F.explode(F.expr(f"sequence(x0 div {STRIP}, x1 div {STRIP})")))
    upper = stripped.select("img_id", (F.col("y") + 1).alias("y"), "strip", F.col("x0").alias("a0"), F.col("x1").alias("a1"), F.col("run").alias("v"))
    met = stripped.join(upper, ["img_id", "y", "strip"]).filter((F.col("x0") <= F.col("a1")) & (F.col("a0") <= F.col("x1")) & (F.expr(f"greatest(x0, a0) div {STRIP}") == F.col("strip")))
    root = least_reached(met.select("img_id", F.col("run").alias("u"), "v"))
    of = all_runs.join(root.withColumnRenamed("u", "run"), ["img_id", "run"], "left").withColumn("root", F.coalesce("v", "run"))
    boxes = of.groupBy("img_id", "root").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.col("x1") - F.col("x0") + 1).cast("int").alias("area"))
    part = F.row_number().over(Window.partitionBy("img_id").orderBy("root")) - 1
    return boxes.withColumn("part", part).select("img_id", "part", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "w", "h", "area")))
