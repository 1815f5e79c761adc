"""Where a text recogniser of one's own is called, batch by batch, on images of cells."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one(read: Callable[[bytes], tuple[str, float]], image: bytes) -> tuple[str, float]:
    try:
        text, confidence = read(bytes(image))
        return text, float(confidence)
    except Exception:
        return "", 0.0


def recognise(cells: DataFrame, read: Callable[[bytes], tuple[str, float]], keep_below: float | None = None) -> DataFrame:
    """cells: doc_id, row_idx, col_idx, image (bytes, null for an empty cell). Adds text, confidence and is_empty; read is
    called for cells that hold an image alone, and a failed call gives no text and confidence 0. keep_below: images read
    with less confidence stay."""

    def batches(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            got = [("", 100.0) if image is None else _one(read, image) for image in part["image"]]
            out = part.drop(columns="image").assign(text=[g[0] for g in got], confidence=[g[1] for g in got], is_empty=part["image"].isna())
            yield out if keep_below is None else out.assign(image=[image if g[1] < keep_below else None for image, g in zip(part["image"], got, strict=True)])

    out = cells.drop("image").withColumns({"text": F.lit(""), "confidence": F.lit(0.0), "is_empty": F.lit(False)})
    schema = out.schema if keep_below is None else out.schema.add(cells.schema["image"])
    return cells.mapInPandas(batches, schema)


def recognise_rows(read: Callable[[bytes], tuple[str, float]]) -> Callable[[Column], Column]:
    """The same for the images of a row, as an array: text and confidence of each, null for those that are null."""

    def rows(images: pd.Series) -> pd.Series:
        return pd.Series([None if row is None else [None if image is None else dict(zip(("text", "confidence"), _one(read, image), strict=True)) for image in row] for row in images], dtype=object)

    kind = "array<struct<text string, confidence double>>"
    return F.pandas_udf(rows, kind).asNondeterministic()  # no image is to be read twice


def scan_lines(images: DataFrame, decode: Callable[[bytes], tuple[int, int, bytes]]) -> DataFrame:
    """images: img_id and content. decode gives the width, the height and 3 bytes (red, green, blue) for each pixel of an
    image, line by line. One row for each scan line: img_id, y, w, h, line, error; and one with an error alone for an image
    that cannot be decoded, or whose bytes do not fit its size. A null content is an error. An image is decoded in one task
    and handed on line by line."""

    def lines(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["img_id", "y", "w", "h", "line", "error"]
        for part in parts:
            for img_id, content in zip(part["img_id"], part["content"], strict=True):
                try:
                    w, h, data = decode(bytes(content))
                    if w <= 0 or h <= 0 or len(data) != 3 * w * h:
                        raise ValueError(f"{len(data)} bytes for {w} by {h} pixels")
                except Exception as e:
                    yield pd.DataFrame([(img_id, None, None, None, None, str(e) or type(e).__name__)], columns=columns).astype({"y": "Int32", "w": "Int32", "h": "Int32"})
                    continue
                for first in range(0, h, 256):
                    yield pd.DataFrame([(img_id, y, w, h, data[3 * w * y : 3 * w * (y + 1)], None) for y in range(first, min(h, first + 256))], columns=columns)

    kind = images.schema["img_id"].dataType.simpleString()
    return images.select("img_id", "content").mapInPandas(lines, f"img_id {kind}, y int, w int, h int, line binary, error string")


def enrich(matched: DataFrame, read: DataFrame, keys: list[str]) -> DataFrame:
    """Matched rows with what was read of them: cells, empty cells, confidence, header and box, by document and row."""
    columns = [c for c in ("columns", "empty_cells", "is_header", "bbox") if c in read.columns]
    return matched.join(read.select(*keys, *columns, F.col("confidence").alias("ocr_confidence")), keys, "left")
