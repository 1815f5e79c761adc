"""Queries over pixels, words and cells of sheets."""

from __future__ import annotations

import re
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import functions as F

from ..operators import grid, healing, scan, words
from ..sources import recognise
from . import relations as R
from .row_queries import cell_sql, classified_sql, schema_sql, trim_sql

THRESHOLD, GAP = 0.2, 1


def binarize(spark, d):
    return grid.binarize(R.pixels(spark, d))


def _line_share(spark, d, axis):
    return grid.projection(R.sparse_ink(spark, d), axis)


def dilate(spark, d):
    return scan.unpack(scan.dilate(scan.pack(R.sparse_ink(spark, d)), 4, 2))


def erode(spark, d):
    return scan.unpack(scan.erode(scan.pack(grid.binarize(R.pixels(spark, d))), 3, 1))


def segment(spark, d):
    """Images wider than the size that is analysed: each pixel stands 17 times across and 3 times down."""
    p = R.spread_pixels(spark, d)
    wide = p.select("img_id", F.explode(F.sequence(F.col("y") * 3, F.col("y") * 3 + 2)).alias("y"), "x", "r", "g", "b").select("img_id", "y", F.explode(F.sequence(F.col("x") * 17, F.col("x") * 17 + 16)).alias("x"), "r", "g", "b")
    return scan.segment(wide)


def _decode(content: bytes) -> tuple[int, int, bytes]:
    """A binary pixel map: P6, width, height and the largest value in lines, then the pixels."""
    magic, size, most, data = content.split(b"\n", 3)
    if magic != b"P6" or most != b"255":
        raise ValueError("no pixel map")
    w, h = map(int, size.split())
    return w, h, data


def image_cells(spark, d):
    """Pixel maps as files, of which some are cut short or of another kind: cells of the good ones, and the bad ones."""
    p = R.spread_pixels(spark, d)
    hexed = F.concat(*(F.lpad(F.hex(c), 2, "0") for c in "rgb"))
    content = p.groupBy("img_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", hexed.alias("p")))).alias("all"), (F.max("y") + 1).alias("h"))
    head = F.concat(F.when(F.col("img_id") % 9 == 5, "P5").otherwise("P6"), F.lit("\n64 "), F.col("h").cast("string"), F.lit("\n255\n"))
    data = F.array_join(F.transform("all", lambda a: a["p"]), "")
    data = F.when(F.col("img_id") % 9 == 4, F.substring(data, 1, 600)).otherwise(data)
    images = content.select("img_id", F.unhex(F.concat(F.hex(F.encode(head, "UTF-8")), data)).alias("content"))
    lines = recognise.scan_lines(images, _decode)
    good = scan.segment_lines(lines.filter("error is null")).withColumn("error", F.lit(None).cast("string"))
    return good.unionByName(lines.filter("error is not null").select("img_id", "error"), allowMissingColumns=True)


def run_components(spark, d):
    return scan.components(scan.pack(R.sparse_ink(spark, d)))


def projection(spark, d):
    return _line_share(spark, d, "y").select("img_id", "at", F.round(F.col("share").cast("double"), 6).alias("share"))


def _each_boundary(spark, d, axis):
    """Each boundary once: with gaps of one line, a middle may be the last line."""
    return grid.boundaries(_line_share(spark, d, axis), THRESHOLD / 4, GAP).distinct()


def boundaries(spark, d):
    return _each_boundary(spark, d, "y")


def cell_grid(spark, d):
    return grid.cells(_each_boundary(spark, d, "y"), _each_boundary(spark, d, "x"))


def crop(spark, d):
    return grid.crop(R.pixels(spark, d), cell_grid(spark, d))


def components(spark, d):
    return grid.connected_components(R.sparse_ink(spark, d)).select("img_id", "x", "y", "w", "h", "area")


def density(spark, d):
    ink = R.sparse_ink(spark, d)
    return grid.density(ink, grid.connected_components(ink)).withColumn("ratio", F.round("ratio", 6))


def downscale(spark, d):
    p = R.table(spark, d, "part")
    w, h = grid.fit(F.col("p_size") * 100, F.col("p_partkey") % 977 + 1, 1000)
    return p.select("p_partkey", w.alias("w"), h.alias("h"))


def sharpened(spark, d):
    """Gray and colour, with and without a threshold."""
    ways = {"gray": {}, "colour": {"grayscale": False}, "black": {"threshold": 127}}
    out = [grid.preprocess(R.pixels(spark, d), brightness=0.1, contrast=0.2, sharpen=True, **how).withColumn("way", F.lit(way)) for way, how in ways.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def word_rows(spark, d):
    out = words.split_columns(words.cluster_rows(R.words(spark, d)))
    return out.select("doc_id", "row_idx", F.array_join("columns", "¦").alias("cells"), F.round("confidence", 6).alias("confidence"), F.round("structural.total", 6).alias("total"), "is_header", "bbox.x0", "bbox.x1")


def heal(spark, d):
    """Lines of documents as cells, some read badly, with a second reading in capitals."""
    rows = R.ocr_rows(spark, d).select("doc_id", "row_idx", F.posexplode("columns").alias("col_idx", "text"))
    k = F.col("doc_id") + F.col("row_idx") + F.col("col_idx")
    cells = rows.select("doc_id", "row_idx", "col_idx", "text", (60 + k % 40).cast("double").alias("confidence"), (k % 11 == 0).alias("is_empty"), F.translate("text", ascii_lowercase, ascii_uppercase).alias("fallback_text"), (65 + k % 9).cast("double").alias("fallback_confidence"))
    return healing.heal(cells).select("doc_id", "row_idx", F.array_join("columns", "¦").alias("cells"), F.round("confidence", 6).alias("confidence"), "is_header", "heal_note")


def _read(image: bytes) -> tuple[str, float]:
    k, text = image.decode().split("|", 1)
    if int(k) % 13 == 0:
        raise ValueError("unreadable")
    return text, 60.0 + int(k) % 40


def _read_again(image: bytes) -> tuple[str, float]:
    k, text = image.decode().split("|", 1)
    return text.translate(str.maketrans(ascii_lowercase, ascii_uppercase)), 65.0 + int(k) % 9


def read_sheets(spark, d):
    """Lines of documents as images of cells, of which a first recogniser fails on some; the second reads in capitals."""
    rows = R.ocr_rows(spark, d).select("doc_id", "row_idx", F.posexplode("columns").alias("col_idx", "text"))
    k = F.col("doc_id") + F.col("row_idx") + F.col("col_idx")
    image = F.when(k % 11 != 0, F.encode(F.concat(k.cast("string"), F.lit("|"), "text"), "UTF-8")).alias("image")
    cells = rows.select("doc_id", "row_idx", "col_idx", image, (F.col("col_idx") * 50).alias("x0"), (F.col("col_idx") * 50 + 44).alias("x1"), (F.col("row_idx") * 30).alias("y0"), (F.col("row_idx") * 30 + 12).alias("y1"))
    out = healing.read_sheets(cells, _read, _read_again)
    bits = F.array_join(F.transform("empty_cells", lambda e: e.cast("int").cast("string")), "")
    return out.select("doc_id", "row_idx", F.array_join("columns", "¦").alias("cells"), bits.alias("empty"), F.round("confidence", 6).alias("confidence"), F.round("structural_confidence.total", 6).alias("total"), "is_header", "heal_note", "region", "bbox.x0", "bbox.x1", "bbox.y0", "bbox.y1")


_PROFILE = R.SPARSE_INK + """,
share_y AS (SELECT img_id, y AS p, CAST(sum(v) / CAST(any_value(w) AS DOUBLE) AS FLOAT) AS share, any_value(h) AS size FROM sparse JOIN size USING (img_id) GROUP BY img_id, y),
share_x AS (SELECT img_id, x AS p, CAST(sum(v) / CAST(any_value(h) AS DOUBLE) AS FLOAT) AS share, any_value(w) AS size FROM sparse JOIN size USING (img_id) GROUP BY img_id, x)"""


def _bounds(axis: str) -> str:
    return f"""gap_{axis} AS (SELECT img_id, p, size, share <= 0.05::DOUBLE AS gap, p - count(*) FILTER (share <= 0.05::DOUBLE) OVER (PARTITION BY img_id ORDER BY p) AS run FROM share_{axis}),
mid_{axis} AS (SELECT img_id, CAST(floor((min(p) + max(p) + 1) / 2::DOUBLE + 0.5) AS INT) AS at0 FROM gap_{axis} WHERE gap GROUP BY img_id, run HAVING max(p) < any_value(size) - 1),
bound_{axis} AS (SELECT img_id, at0 FROM mid_{axis} UNION SELECT img_id, 0 FROM size UNION SELECT DISTINCT img_id, CAST(size - 1 AS INT) FROM share_{axis}),
span_{axis} AS (SELECT img_id, row_number() OVER w - 1 AS idx, at0 AS low, lead(at0) OVER w AS high FROM bound_{axis} WINDOW w AS (PARTITION BY img_id ORDER BY at0) QUALIFY lead(at0) OVER w IS NOT NULL)"""


def _line(x: str) -> str:
    return f"replace({trim_sql(x)}, chr(10), ' ')"


def _heal_sql(failed: str) -> str:
    """Cells as first read, and where `failed` holds not at all, to healed rows."""
    return rf"""{R.OCR_ROWS}, cell0 AS (SELECT doc_id, row_idx, unnest(range(len(columns))) AS i, unnest(columns) AS t FROM ocr_rows), cell AS (SELECT *, doc_id + row_idx + i AS k FROM cell0),
grid AS (
  SELECT r.doc_id, r.row_idx, r.i, width, CASE WHEN k % 11 = 0 OR {failed} THEN '' ELSE coalesce({_line('t')}, '') END AS text, CAST(CASE WHEN k IS NULL THEN 0 WHEN k % 11 = 0 THEN 100 WHEN {failed} THEN 0 ELSE 60 + k % 40 END AS DOUBLE) AS conf, coalesce(k % 11 = 0, false) AS is_empty,
    coalesce({_line(f"translate(t, '{ascii_lowercase}', '{ascii_uppercase}')")}, '') AS again, CASE WHEN k IS NOT NULL THEN CAST(65 + k % 9 AS DOUBLE) END AS fb
  FROM (SELECT doc_id, row_idx, width, unnest(range(width)) AS i FROM (SELECT DISTINCT doc_id, row_idx FROM cell) JOIN (SELECT doc_id, max(i) + 1 AS width FROM cell GROUP BY doc_id) USING (doc_id)) r
  LEFT JOIN cell c ON c.doc_id = r.doc_id AND c.row_idx = r.row_idx AND c.i = r.i
), locked AS (
  SELECT doc_id, row_idx, list(text ORDER BY i) AS columns, false AS is_header, string_agg(text, '  ' ORDER BY i) FILTER (text <> '') AS text FROM grid WHERE row_idx < 4
  GROUP BY doc_id, row_idx HAVING count(*) FILTER ({trim_sql('text')} <> '') > 0
), {classified_sql('locked', '1')}, {schema_sql()},
typed AS (
  SELECT g.*, kind, CASE WHEN g.row_idx >= 4 AND kind = 'numeric' THEN regexp_replace(text, '[^0-9.\-]', '', 'g') ELSE text END AS read, conf < 70 AND coalesce(fb, -1) > conf AS better
  FROM grid g LEFT JOIN kinds n ON n.doc_id = g.doc_id AND n.col_idx = g.i
), cleaned AS (SELECT *, {cell_sql('read', 'kind')} AS first, {cell_sql('CASE WHEN better THEN again ELSE read END', 'kind')} AS second FROM typed),
state AS (
  SELECT doc_id, row_idx, count(*) FILTER (len({trim_sql('first')}) > 1) = 0 AS noise, count(*) FILTER (len({trim_sql('first')}) > 1) = 0 OR sum(conf) / CAST(any_value(width) AS DOUBLE) < 75 AS weak, bool_or(better) AS better
  FROM cleaned GROUP BY doc_id, row_idx HAVING count(*) FILTER ({trim_sql('read')} <> '') > 0
),
healed AS (SELECT c.doc_id, c.row_idx, string_agg(CASE WHEN NOT weak THEN first WHEN s.better THEN second ELSE read END, '¦' ORDER BY i) AS cells, list(CASE WHEN NOT weak THEN first WHEN s.better THEN second ELSE read END ORDER BY i) AS columns, string_agg(CAST(CAST(is_empty AS INT) AS VARCHAR), '' ORDER BY i) AS empty,
  sum(CASE WHEN weak AND c.better THEN fb ELSE conf END) / CAST(any_value(width) AS DOUBLE) AS whole, round(whole, 6) AS confidence,
  c.row_idx < 4 AND (c.doc_id, c.row_idx) IN (SELECT (doc_id, row_idx) FROM classified WHERE region = 'header') AS is_header,
  trim(CASE WHEN any_value(weak AND noise) THEN 'Corrected: Row appears to be visual noise or separator line | ' ELSE '' END || CASE WHEN any_value(weak AND s.better) THEN 'Healed low-confidence cells using fallback model.' ELSE '' END) AS heal_note
FROM cleaned c JOIN state s ON s.doc_id = c.doc_id AND s.row_idx = c.row_idx GROUP BY c.doc_id, c.row_idx)"""


#: Healed lines, classified once more under names of their own.
_FINAL = re.sub(r"\b(marked|counted|cased|classified)\b", r"\1_final", classified_sql("lines"))

_PARTS = R.SPARSE_INK + """,
inked AS (SELECT img_id, y * 1000 + x AS id, y, x FROM sparse WHERE v = 1),
edge AS (SELECT a.img_id, a.id AS u, b.id AS v FROM inked a JOIN inked b ON a.img_id = b.img_id AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
reach AS (SELECT img_id, id AS u, id AS v FROM inked UNION SELECT r.img_id, r.u, e.v FROM reach r JOIN edge e ON e.img_id = r.img_id AND e.u = r.v),
label AS (SELECT img_id, u AS id, min(v) AS part FROM reach GROUP BY ALL),
parts AS (SELECT img_id, part, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS area FROM label JOIN inked USING (img_id, id) GROUP BY img_id, part)"""


def _bands(axis: str, other: str, across: int, along: int, threshold: float, gap: int) -> str:
    """Boundaries of one axis, by spreading ink with running maxima, projecting it and going through the gaps."""
    n, m = ("sh", "sw") if axis == "y" else ("sw", "sh")
    return f"""s1{axis} AS (SELECT img_id, x, y, max(v) OVER (PARTITION BY img_id, y ORDER BY x ROWS BETWEEN {across} PRECEDING AND {across} FOLLOWING) AS v FROM small),
s2{axis} AS (SELECT img_id, x, y, max(v) OVER (PARTITION BY img_id, x ORDER BY y ROWS BETWEEN {along} PRECEDING AND {along} FOLLOWING) AS v FROM s1{axis}),
p{axis} AS (SELECT s.img_id, {axis} AS p, any_value({n}) AS size, any_value(scale) AS scale, CAST(sum(v) / CAST(any_value({m}) AS DOUBLE) AS FLOAT) <= {threshold}::DOUBLE AS gap FROM s2{axis} s JOIN dims USING (img_id) GROUP BY s.img_id, {axis}),
g{axis} AS (SELECT *, p - count(*) FILTER (gap) OVER (PARTITION BY img_id ORDER BY p) AS run FROM p{axis}),
m{axis} AS (SELECT img_id, floor((min(p) + max(p) + 1) / 2::DOUBLE + 0.5) AS p, any_value(scale) AS scale FROM g{axis} WHERE gap GROUP BY img_id, run
  HAVING max(p) < any_value(size) - 1 AND count(*) >= greatest(3, floor({gap} / any_value(scale) + 0.5))),
bd{axis} AS (SELECT img_id, CAST(floor(p * scale + 0.5) AS INT) AS p FROM (SELECT img_id, p, scale FROM m{axis} UNION ALL SELECT img_id, unnest([0, {n} - 1]), scale FROM dims)),
i{axis} AS (SELECT img_id, row_number() OVER w - 1 AS idx, p AS low, lead(p) OVER w AS high FROM bd{axis} WINDOW w AS (PARTITION BY img_id ORDER BY p) QUALIFY lead(p) OVER w IS NOT NULL)"""


_SEGMENT = f"""dims AS (SELECT img_id, w, h, scale, CASE WHEN w > h AND w > 1000 THEN 1000 ELSE CAST(floor(w / scale + 0.5) AS INT) END AS sw, CASE WHEN h >= w AND h > 1000 THEN 1000 ELSE CAST(floor(h / scale + 0.5) AS INT) END AS sh
  FROM (SELECT img_id, max(x) + 1 AS w, max(y) + 1 AS h, greatest(1.0::DOUBLE, greatest(max(x) + 1, max(y) + 1) / 1000.0::DOUBLE) AS scale FROM image GROUP BY img_id)),
place AS (SELECT img_id, scale, sw, ty FROM (SELECT *, unnest(range(sh)) AS ty FROM dims)),
target AS (SELECT img_id, tx, ty, CAST(floor((tx + 0.5::DOUBLE) * scale) AS INT) AS x, CAST(floor((ty + 0.5::DOUBLE) * scale) AS INT) AS y FROM (SELECT *, unnest(range(sw)) AS tx FROM place)),
small AS (SELECT t.img_id, tx AS x, ty AS y, CASE WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b < 160 THEN 1 ELSE 0 END AS v FROM target t JOIN image i ON i.img_id = t.img_id AND i.x = t.x AND i.y = t.y),
{_bands('y', 'x', 10, 1, 0.015, 8)}, {_bands('x', 'y', 1, 10, 0.005, 10)},
cell AS (SELECT r.img_id, r.idx AS row_idx, c.idx AS col_idx, c.low + 3 AS x, r.low + 3 AS y, greatest(20, c.high - c.low - 6) AS w, greatest(20, r.high - r.low - 6) AS h FROM iy r JOIN ix c ON r.img_id = c.img_id)"""

QUERIES = {
    "q_binarize": binarize, "q_dilate": dilate, "q_erode": erode, "q_projection": projection, "q_boundaries": boundaries, "q_cell_grid": cell_grid, "q_crop": crop, "q_components": components, "q_density": density,
    "q_segment": segment, "q_image_cells": image_cells, "q_run_components": run_components,
    "q_downscale": downscale, "q_sharpen": sharpened, "q_word_rows": word_rows, "q_heal": heal, "q_read_sheets": read_sheets,
}
SQL = {
    "q_binarize": f"WITH {R.PIXELS} SELECT img_id, y, x, v FROM ink",
    "q_dilate": f"""WITH {R.SPARSE_INK}, hit AS (SELECT DISTINCT s.img_id, s.y + dy.d AS y, s.x + dx.d AS x FROM sparse s, (SELECT unnest(range(-1, 2)) AS d) dy, (SELECT unnest(range(-2, 3)) AS d) dx WHERE v = 1)
SELECT s.img_id, s.y, s.x, CASE WHEN h.img_id IS NULL THEN 0 ELSE 1 END AS v FROM sparse s LEFT JOIN hit h ON h.img_id = s.img_id AND h.y = s.y AND h.x = s.x""",
    "q_erode": f"""WITH {R.PIXELS} SELECT img_id, y, x, CASE WHEN coalesce(lag(v) OVER w, 0) + v + coalesce(lead(v) OVER w, 0) = 3 THEN 1 ELSE 0 END AS v FROM ink WINDOW w AS (PARTITION BY img_id, y ORDER BY x)""",
    "q_projection": f"WITH {_PROFILE} SELECT img_id, p AS at, round(CAST(share AS DOUBLE), 6) AS share FROM share_y".replace("AS at,", 'AS "at",'),
    "q_boundaries": f"WITH {_PROFILE}, {_bounds('y')} SELECT img_id, at0 AS \"at\" FROM bound_y",
    "q_cell_grid": f"""WITH {_PROFILE}, {_bounds('y')}, {_bounds('x')} SELECT r.img_id, r.idx AS row_idx, c.idx AS col_idx, c.low + 3 AS x, r.low + 3 AS y, greatest(20, c.high - c.low - 6) AS w, greatest(20, r.high - r.low - 6) AS h
FROM span_y r JOIN span_x c ON r.img_id = c.img_id""",
    "q_crop": f"""WITH {_PROFILE}, {_bounds('y')}, {_bounds('x')}, box AS (SELECT r.img_id, r.idx AS row_idx, c.idx AS col_idx, c.low + 3 AS x, r.low + 3 AS y, greatest(20, c.high - c.low - 6) AS w, greatest(20, r.high - r.low - 6) AS h
  FROM span_y r JOIN span_x c ON r.img_id = c.img_id)
SELECT b.img_id, row_idx, col_idx, 3 * (p.y - b.y) + dy.d AS y, 3 * (p.x - b.x) + dx.d AS x, CASE WHEN 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * p.b < 140 THEN 1 ELSE 0 END AS v
FROM box b JOIN pixels p ON p.img_id = b.img_id AND p.y >= b.y AND p.y < b.y + h AND p.x >= b.x AND p.x < b.x + w, (SELECT unnest(range(3)) AS d) dy, (SELECT unnest(range(3)) AS d) dx""",
    "q_segment": f"WITH {R.SPREAD_PIXELS}, image AS (SELECT img_id, y * 3 + dy.d AS y, x * 17 + dx.d AS x, r, g, b FROM spread, (SELECT unnest(range(3)) AS d) dy, (SELECT unnest(range(17)) AS d) dx), {_SEGMENT} SELECT * FROM cell",
    "q_image_cells": f"""WITH {R.SPREAD_PIXELS}, image AS (SELECT * FROM spread WHERE img_id % 9 NOT IN (4, 5)), {_SEGMENT} SELECT *, NULL AS error FROM cell
UNION ALL SELECT img_id, NULL, NULL, NULL, NULL, NULL, NULL, CASE WHEN img_id % 9 = 4 THEN '300 bytes for 64 by ' || (max(y) + 1) || ' pixels' ELSE 'no pixel map' END FROM spread WHERE img_id % 9 IN (4, 5) GROUP BY img_id""",
    "q_run_components": f"WITH RECURSIVE {_PARTS} SELECT img_id, CAST(row_number() OVER (PARTITION BY img_id ORDER BY part) - 1 AS INT) AS part, x, y, w, h, area FROM parts",
    "q_components": f"WITH RECURSIVE {_PARTS} SELECT img_id, x, y, w, h, area FROM parts",
    "q_density": f"""WITH RECURSIVE {_PARTS}, page AS (SELECT img_id, avg(v) AS ratio, max(x) + 1 AS iw, max(y) + 1 AS ih FROM sparse GROUP BY img_id),
n AS (SELECT img_id, count(*) AS n, count(*) FILTER (area >= 8 AND w / h::DOUBLE BETWEEN 0.1 AND 10 AND NOT ((x <= 2 OR y <= 2 OR x + w >= iw - 2 OR y + h >= ih - 2) AND (w > 0.8 * iw OR h > 0.8 * ih))) AS kept FROM parts JOIN page USING (img_id) GROUP BY img_id)
SELECT img_id, ratio < 0.005 OR coalesce(kept, 0) = 0 AS is_empty, round(ratio, 6) AS ratio, CASE WHEN ratio < 0.005 THEN 0 WHEN coalesce(kept, 0) = 0 THEN coalesce(n, 0) ELSE kept END AS n_parts,
  CASE WHEN ratio < 0.005 THEN 'Zero ink detected' WHEN coalesce(kept, 0) = 0 THEN 'Only noise or borders detected' END AS reason FROM page LEFT JOIN n USING (img_id)""",
    "q_downscale": """SELECT p_partkey, CAST(floor(w * s + 0.5) AS INT) AS w, CAST(floor(h * s + 0.5) AS INT) AS h FROM (SELECT *, least(1.0::DOUBLE, 1000.0::DOUBLE / greatest(w, h)) AS s
  FROM (SELECT p_partkey, p_size * 100 AS w, p_partkey % 977 + 1 AS h FROM part))""",
    "q_sharpen": f"""WITH {R.PIXELS}, way AS (SELECT unnest(['gray', 'colour', 'black']) AS way),
input AS (SELECT way, img_id, y, x, c, CASE WHEN way = 'colour' THEN CAST(v AS DOUBLE) ELSE 0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b END AS v
  FROM (SELECT *, unnest(['r', 'g', 'b']) AS c, unnest([r, g, b]) AS v FROM pixels), way),
base AS (SELECT * EXCLUDE v, round_even(greatest(0.0::DOUBLE, least(255.0::DOUBLE, (v + 0.1::DOUBLE * 255 - 128) * 1.2::DOUBLE + 128)), 0) AS v FROM input),
cut AS (SELECT * EXCLUDE v, CASE WHEN way <> 'black' THEN v WHEN v > 127 THEN 255 ELSE 0 END AS v FROM base),
sharp AS (SELECT way, img_id, y, x, c, CAST(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 5 * v - coalesce(lag(v) OVER r, 0) - coalesce(lead(v) OVER r, 0) - coalesce(lag(v) OVER k, 0) - coalesce(lead(v) OVER k, 0))) AS INT) AS v
  FROM cut WINDOW r AS (PARTITION BY way, c, img_id, y ORDER BY x), k AS (PARTITION BY way, c, img_id, x ORDER BY y))
SELECT way, img_id, y, x, max(v) FILTER (c = 'r') AS r, max(v) FILTER (c = 'g') AS g, max(v) FILTER (c = 'b') AS b FROM sharp GROUP BY way, img_id, y, x""",
    "q_word_rows": f"""WITH {R.WORDS}, line AS (SELECT *, word_ord // 8 AS k, CASE WHEN word_ord % 8 >= 4 THEN 1 ELSE 0 END AS half, avg(y0 + 6) OVER (PARTITION BY doc_id, word_ord // 8) AS mid FROM words),
gaps AS (SELECT *, x0 - lag(x0 + 50) OVER w > 18 AS gap FROM line WINDOW w AS (PARTITION BY doc_id, k ORDER BY x0)),
cut AS (SELECT *, count(*) FILTER (coalesce(gap, false)) OVER (PARTITION BY doc_id, k ORDER BY x0) AS c FROM gaps),
cell AS (SELECT doc_id, k, c, regexp_replace(regexp_replace(string_agg(text, ' ' ORDER BY x0), '^[\\[|]+', ''), '[\\]|]+$', '') AS cell FROM cut GROUP BY ALL),
joined AS (SELECT doc_id, k, string_agg(trim(cell), '¦' ORDER BY c) AS cells, count(*) AS n, bool_or(regexp_matches(lower(cell), 'name|sr|designation|total|present|register')) AS hint FROM cell WHERE trim(cell) <> '' GROUP BY ALL),
stat AS (SELECT doc_id, k, avg(confidence) AS conf, avg(abs(y0 + 6 - mid)) AS off, min(x0) AS x0, max(x0 + 50) AS x1 FROM line GROUP BY ALL)
SELECT doc_id, CAST(dense_rank() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS INT) AS row_idx, cells, round(conf, 6) AS confidence, round((greatest(0, 100 - 5 * off) + CASE WHEN n > 1 THEN 75 ELSE 50 END + conf) / 3, 6) AS total,
  dense_rank() OVER (PARTITION BY doc_id ORDER BY k) <= 2 OR hint AS is_header, x0, x1 FROM joined JOIN stat USING (doc_id, k)""",
    "q_heal": f"WITH {_heal_sql('false')} SELECT doc_id, row_idx, cells, confidence, is_header, heal_note FROM healed",
    "q_read_sheets": f"""WITH {_heal_sql('k % 13 = 0')}, box AS (SELECT doc_id, row_idx, 0 AS x0, (SELECT max(i) FROM cell t WHERE t.doc_id = c.doc_id) * 50 + 44 AS x1, row_idx * 30 AS y0, row_idx * 30 + 12 AS y1 FROM cell c GROUP BY doc_id, row_idx),
lines AS (SELECT doc_id, row_idx, columns, is_header, array_to_string(list_filter(columns, lambda x: x <> ''), '  ') AS text FROM healed),
{_FINAL},
near AS (SELECT f.doc_id, f.row_idx, f.region, b.x0, b.x1, b.y0, b.y1, f.region = 'header' AND lag(f.region) OVER w = 'header' AND abs(b.y0 - lag(b.y1) OVER w) < 20 AS joins, row_number() OVER w AS at0
  FROM classified_final f JOIN box b ON b.doc_id = f.doc_id AND b.row_idx = f.row_idx WINDOW w AS (PARTITION BY f.doc_id ORDER BY f.row_idx)),
placed AS (SELECT *, at0 - max(at0) FILTER (NOT coalesce(joins, false)) OVER (PARTITION BY doc_id ORDER BY row_idx) AS place, lead(coalesce(joins, false)) OVER (PARTITION BY doc_id ORDER BY row_idx) AS followed FROM near),
joined AS (SELECT p.*, h.* EXCLUDE (doc_id, row_idx), lead(h.columns) OVER (PARTITION BY p.doc_id ORDER BY p.row_idx) AS under FROM placed p JOIN healed h ON h.doc_id = p.doc_id AND h.row_idx = p.row_idx)
SELECT doc_id, row_idx, CASE WHEN coalesce(followed, false) AND region = 'header' THEN array_to_string(list_transform(columns, lambda c, i: CASE WHEN coalesce(under[i], '') <> '' THEN {trim_sql("c || ' ' || under[i]")} ELSE c END), '¦') ELSE cells END AS cells,
  empty, confidence, round((185 + whole) / 3, 6) AS total, is_header, heal_note, region, x0, x1, y0, y1 FROM joined WHERE place % 2 = 0 AND region <> 'empty'""",
}
