"""Queries of cleaning, validating, classifying and typing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import columns as C
from ..operators import rows as O
from . import relations as R


def _dirty(spark, d):
    """Names and numbers with noise, by which part of the table they come from."""
    p = R.table(spark, d, "part")
    k = F.col("p_partkey")
    raw = (
        F.when(k % 6 == 0, F.concat(F.lit("[|"), F.col("p_name"), F.lit(".|")))
        .when(k % 6 == 1, F.concat(F.lit("O"), k.cast("string"), F.lit(",lS B")))
        .when(k % 6 == 2, F.element_at(F.array(*map(F.lit, ("present", "Half ", "h", "xyz", "WFH", "sunday"))), (k % 5 + 1).cast("int")))
        .when(k % 6 == 3, F.concat(F.lit(" o'"), F.upper("p_name"), F.lit(" - a|b-c ")))
        .when(k % 6 == 4, F.lit("  \t "))
        .otherwise(F.concat(F.lit("\t"), F.lit("I"), k.cast("string"), F.lit(".]")))
    )
    kind = F.element_at(F.array(*map(F.lit, ("numeric", "name", "status", "serial", "text"))), (F.floor(k / 6) % 5 + 1).cast("int"))
    return p.select(k.alias("id"), raw.alias("raw"), kind.alias("kind"))


_DIRTY = """dirty AS (
  SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '[|' || p_name || '.|' WHEN 1 THEN 'O' || p_partkey || ',lS B' WHEN 2 THEN ['present', 'Half ', 'h', 'xyz', 'WFH', 'sunday'][p_partkey % 5 + 1]
    WHEN 3 THEN ' o''' || upper(p_name) || ' - a|b-c ' WHEN 4 THEN '  ' || chr(9) || ' ' ELSE chr(9) || 'I' || p_partkey || '.]' END AS raw,
    ['numeric', 'name', 'status', 'serial', 'text'][(p_partkey // 6) % 5 + 1] AS kind FROM part)"""
_TRIM = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"


def trim_sql(x: str) -> str:
    return _TRIM.format(x)


def _numeric(x: str) -> str:
    return f"coalesce(nullif(regexp_replace(translate({x}, 'OlISB', '01158'), '[^0-9.]', '', 'g'), ''), {x})"


def _serial(x: str) -> str:
    return f"regexp_replace(translate({x}, 'OlI', '011'), '[^0-9.]', '', 'g')"


def _status(x: str) -> str:
    marks = ", ".join(f"'{k}': '{v}'" for k, v in T.MARKERS.items())
    return f"coalesce(MAP {{{marks}}}[lower({trim_sql(x)})], upper({trim_sql(x)}))"


def _name(x: str) -> str:
    runs = f"regexp_extract_all(lower(replace({x}, '|', 'I')), '([A-Za-z0-9_]+|[^A-Za-z0-9_]+)')"
    title = f"array_to_string(list_transform({runs}, lambda t: CASE WHEN regexp_matches(t, '^[a-z]') THEN upper(t[1]) || t[2:] ELSE t END), '')"
    return trim_sql(rf"regexp_replace({trim_sql(title)}, '\s[^A-Za-z\d]\s', ' ', 'g')")


def cell_sql(x: str, kind: str) -> str:
    text = trim_sql(rf"regexp_replace(regexp_replace({trim_sql(x)}, '^[\[|\].]+', ''), '[\[|\].]+$', '')")
    return f"CASE WHEN coalesce({trim_sql(x)}, '') = '' THEN '' WHEN {kind} = 'numeric' THEN {_numeric(text)} WHEN {kind} = 'name' THEN {_name(text)} WHEN {kind} = 'status' THEN {_status(text)} WHEN {kind} = 'serial' THEN {_serial(text)} ELSE replace({text}, '|', 'I') END"


def _clean(function):
    return lambda spark, d: _dirty(spark, d).select("id", function("raw").alias("cleaned"))


def clean_dispatch(spark, d):
    return _dirty(spark, d).select("id", "kind", T.clean_cell("raw", "kind").alias("cleaned"))


def cell_shapes(spark, d):
    cells = R.ocr_rows(spark, d).select("doc_id", "row_idx", F.posexplode("columns").alias("col_idx", "cell"))
    dates = R.sessions(spark, d).select(F.col("id").cast("long").alias("doc_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.date_format("session_date", "dd/MM/yyyy").alias("cell"))
    return cells.union(dates).select("doc_id", "row_idx", "col_idx", C.shape(F.col("cell")).alias("shape"))


def character_rules(spark, d):
    return _dirty(spark, d).select("id", T.apply_character_rules("raw").alias("cleaned"))


def display_values(spark, d):
    m = R.members(spark, d)
    return m.select("id", T.display("department").alias("department"), T.display("email").alias("email"), T.cut("full_name").alias("short"), T.percent(F.col("member_ord") % 101 / 101).alias("share"))


def validate_row(spark, d):
    rows = O.validate_row(R.ocr_rows(spark, d), F.lit(3), F.array(F.lit("name"), F.lit("numeric"), F.lit("text")))
    return rows.select("doc_id", "row_idx", F.array_join("corrected", "¦").alias("corrected"), F.array_join("issues", "; ").alias("issues"), "is_valid")


def validate_documents(spark, d):
    v = O.validate_documents(R.ocr_rows(spark, d))
    return v.withColumn("outliers", F.array_join(F.transform("outliers", lambda x: x.cast("string")), ","))


def drop_blank(spark, d):
    return O.drop_blank_rows(R.ocr_rows(spark, d)).select("doc_id", "row_idx")


def padded(spark, d):
    return R.ocr_rows(spark, d).select("doc_id", "row_idx", F.array_join(O.pad("columns", F.lit(4)), "¦").alias("cells"))


def classify(spark, d):
    return O.classify(R.ocr_rows(spark, d)).select("doc_id", "row_idx", "region", "region_confidence", "explanation")


def merge_headers(spark, d):
    merged = O.merge_headers(O.classify(R.ocr_rows(spark, d)))
    return merged.select("doc_id", "row_idx", "region", "explanation", F.array_join("columns", "¦").alias("cells"), F.when(F.col("region") == "header", F.col("text")).alias("header_text"))


def summarise(spark, d):
    s = O.summarise(O.classify(R.ocr_rows(spark, d)))
    return s.select("doc_id", "table_start", "table_end", "title", F.array_join("metadata", "¦").alias("metadata"), F.round("overall_confidence", 6).alias("overall_confidence"))


def infer_schema(spark, d):
    return C.infer_schema(O.classify(R.ocr_rows(spark, d))).withColumn("samples", F.array_join("samples", "¦"))


def workspace_types(spark, d):
    return C.workspace_schema(R.ocr_rows(spark, d))


def _found(words: list[str]) -> str:
    return f"len(list_filter([{', '.join(repr(w) for w in words)}], lambda w: contains(low, w)))"


_BLANK = f"len(list_filter(columns, lambda c: {trim_sql('c')} <> '')) = 0"


def classified_sql(source: str, n_rows: str = "count(*) OVER (PARTITION BY doc_id)") -> str:
    return f"""marked AS (
  SELECT *, {trim_sql('text')} AS trimmed, lower({trim_sql('text')}) AS low, {n_rows} AS n_rows FROM {source}
), counted AS (SELECT *, {_found(O.HEADER_WORDS)} AS heads, {_found(O.TITLE_WORDS)} AS titles, {_found(O.METADATA_WORDS)} AS metas, {_found(O.FOOTER_WORDS)} AS feet FROM marked),
cased AS (
  SELECT *, CASE WHEN trimmed = '' OR {_BLANK} THEN 0 WHEN row_idx < 4 AND len(columns) <= 2 AND titles > 0 THEN 1 WHEN row_idx < 4 AND len(columns) <= 2 AND metas > 0 THEN 2
    WHEN len(columns) <= 2 AND metas > 0 THEN 3 WHEN heads >= 2 THEN 4 WHEN is_header AND heads >= 1 THEN 5 WHEN row_idx > n_rows * 0.85::DOUBLE AND feet > 0 THEN 6 ELSE 7 END AS k FROM counted
), classified AS (
  SELECT *, ['empty', 'title', 'metadata', 'metadata', 'header', 'header', 'footer', 'data'][k + 1] AS region, [99, 90, 85, 80, 90, 75, 80, 70][k + 1] AS region_confidence,
    ['No text content detected', 'Contains title keyword in top region', 'Contains metadata pattern', 'Matches metadata pattern', heads || ' header keywords detected', 'Geometric header + 1 keyword',
     'Summary row in footer region', 'Default data row classification'][k + 1] AS explanation FROM cased)"""


_CLASSIFIED = f"{R.OCR_ROWS}, {classified_sql('ocr_rows')}"


def _label_case(labels) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower(label), '{p}') THEN '{k}'" for k, p in labels) + " END"


def schema_sql() -> str:
    return f"""widths AS (SELECT doc_id, greatest(coalesce(max(len(columns)) FILTER (region IN ('header', 'data')), 0), 1) AS width FROM classified GROUP BY doc_id),
first AS (SELECT doc_id, arg_min(columns, row_idx) AS header FROM classified WHERE region = 'header' GROUP BY doc_id),
labels AS (SELECT doc_id, col_idx, coalesce(header[col_idx + 1], 'Col ' || (col_idx + 1)) AS label FROM (SELECT doc_id, unnest(range(width)) AS col_idx FROM widths) LEFT JOIN first USING (doc_id)),
cells AS (SELECT doc_id, row_idx, unnest(range(len(columns))) AS col_idx, unnest(columns) AS cell FROM classified WHERE region = 'data'),
sampled AS (SELECT *, row_number() OVER (PARTITION BY doc_id, col_idx ORDER BY row_idx) AS k FROM cells WHERE {trim_sql('cell')} <> '' QUALIFY k <= 10),
samples AS (SELECT doc_id, col_idx, count(*) AS n, string_agg(cell, '¦' ORDER BY k) AS samples, avg(CAST(regexp_matches({trim_sql('cell')}, '^[0-9]+(\\.[0-9]+)?$') AS INT)) AS numbers,
  avg(CAST(regexp_matches({trim_sql('cell')}, '^[A-Z][a-z]+(\\s[A-Z][a-z]+)+') AS INT)) AS names,
  avg(CAST(len(list_filter([{', '.join(repr(w) for w in C.DESIGNATION_WORDS)}], lambda w: contains(lower(cell), w))) > 0 AS INT)) AS designations FROM sampled GROUP BY ALL),
kinds AS (SELECT doc_id, col_idx, coalesce({_label_case(C.LABELS)}, CASE WHEN n IS NULL THEN 'unknown' WHEN numbers > 0.7 THEN 'numeric' WHEN names > 0.4 THEN 'name' WHEN designations > 0.4 THEN 'designation' ELSE 'text' END) AS kind,
  label, CASE WHEN coalesce(n, 0) > 3 THEN 80 ELSE 50 END AS confidence, coalesce(samples, '') AS samples FROM labels LEFT JOIN samples USING (doc_id, col_idx))"""


_FIT = "CASE WHEN len(columns) < 3 THEN columns || list_transform(range(3 - len(columns)), lambda i: '') WHEN len(columns) > 3 THEN columns[1:2] || [array_to_string(columns[3:], ' ')] ELSE columns END"

QUERIES = {
    "q_clean_numeric": _clean(T.clean_numeric), "q_clean_name": _clean(T.clean_name), "q_clean_status": _clean(T.clean_status), "q_clean_serial": _clean(T.clean_serial),
    "q_clean_dispatch": clean_dispatch, "q_char_rules": character_rules, "q_cell_shapes": cell_shapes, "q_number_marks": _clean(T.keep_number_marks), "q_one_line": _clean(T.one_line), "q_display": display_values,
    "q_validate_row": validate_row, "q_validate_doc": validate_documents, "q_drop_blank": drop_blank, "q_pad": padded, "q_classify": classify, "q_merge_headers": merge_headers,
    "q_doc_summary": summarise, "q_infer_schema": infer_schema, "q_workspace_types": workspace_types,
}
SQL = {
    "q_clean_numeric": f"WITH {_DIRTY} SELECT id, {_numeric('raw')} AS cleaned FROM dirty",
    "q_clean_name": f"WITH {_DIRTY} SELECT id, {_name('raw')} AS cleaned FROM dirty",
    "q_clean_status": f"WITH {_DIRTY} SELECT id, {_status('raw')} AS cleaned FROM dirty",
    "q_clean_serial": f"WITH {_DIRTY} SELECT id, {_serial('raw')} AS cleaned FROM dirty",
    "q_clean_dispatch": f"WITH {_DIRTY} SELECT id, kind, {cell_sql('raw', 'kind')} AS cleaned FROM dirty",
    "q_cell_shapes": rf"""WITH {R.OCR_ROWS}, {R.SESSIONS}, cells AS (SELECT doc_id, row_idx, unnest(range(len(columns))) AS col_idx, unnest(columns) AS cell FROM ocr_rows UNION ALL SELECT CAST(id AS BIGINT), 0, 0, strftime(session_date, '%d/%m/%Y') FROM sessions),
t AS (SELECT doc_id, row_idx, col_idx, {trim_sql('cell')} AS t FROM cells)
SELECT doc_id, row_idx, col_idx, CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}\.?$') THEN 'serial' WHEN regexp_matches(t, '^[0-9]+(\.[0-9]+)?$') THEN 'numeric' WHEN regexp_matches(t, '^[0-9]{{1,3}}(\.[0-9]+)?%?$') THEN 'percentage'
  WHEN regexp_matches(t, '[0-9]{{1,2}}[/.-][0-9]{{1,2}}([/.-][0-9]{{2,4}})?') THEN 'date' WHEN regexp_matches(t, '^[A-Z][a-z]+(\s[A-Z][a-z]+)+') THEN 'name' END AS shape FROM t""",
    "q_number_marks": rf"WITH {_DIRTY} SELECT id, regexp_replace(raw, '[^0-9.\-]', '', 'g') AS cleaned FROM dirty",
    "q_one_line": f"WITH {_DIRTY} SELECT id, replace({trim_sql('raw')}, chr(10), ' ') AS cleaned FROM dirty",
    "q_display": f"""WITH {R.MEMBERS} SELECT id, coalesce(nullif(department, ''), '-') AS department, coalesce(nullif(email, ''), '-') AS email,
  CASE WHEN len(full_name) > 12 THEN left(full_name, 12) || '…' ELSE full_name END AS short, CAST(floor((member_ord % 101) / 101::DOUBLE * 100 + 0.5) AS BIGINT) || '%' AS share FROM members""",
    "q_validate_row": f"""WITH {R.OCR_ROWS}, fitted AS (SELECT doc_id, row_idx, len(columns) AS n, {_FIT} AS f FROM ocr_rows),
cleaned AS (SELECT doc_id, row_idx, n, [{cell_sql('f[1]', "'name'")}, {cell_sql('f[2]', "'numeric'")}, {cell_sql('f[3]', "'text'")}] AS c FROM fitted),
issued AS (SELECT *, list_filter([CASE WHEN n < 3 THEN 'Missing ' || (3 - n) || ' column(s) — padding with empty cells' WHEN n > 3 THEN 'Extra ' || (n - 3) || ' column(s) — likely merged cell or OCR split' END,
  CASE WHEN len(list_filter(c, lambda x: len({trim_sql('x')}) > 1)) = 0 THEN 'Row appears to be visual noise or separator line' END], lambda x: x IS NOT NULL) AS i FROM cleaned)
SELECT doc_id, row_idx, array_to_string(c, '¦') AS corrected, array_to_string(i, '; ') AS issues, len(i) = 0 AS is_valid FROM issued""",
    "q_validate_doc": f"""WITH {R.OCR_ROWS}, data AS (SELECT doc_id, len(columns) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY row_idx) - 1 AS pos FROM ocr_rows WHERE NOT is_header),
top AS (SELECT doc_id, w AS dominant FROM (SELECT doc_id, w, count(*) AS n FROM data GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, w) = 1),
found AS (SELECT doc_id, any_value(dominant) AS dominant, count(*) AS n, count(*) FILTER (w <> dominant) AS odd, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (w <> dominant) AS outliers FROM data JOIN top USING (doc_id) GROUP BY doc_id)
SELECT doc_id, coalesce(odd / n < 0.15, true) AS consistent, CAST(coalesce(dominant, 0) AS INT) AS dominant, coalesce(outliers, '') AS outliers,
  CASE WHEN odd = 0 THEN 'high' WHEN odd / n < 0.3 THEN 'medium' ELSE 'low' END AS quality FROM (SELECT DISTINCT doc_id FROM ocr_rows) LEFT JOIN found USING (doc_id)""",
    "q_drop_blank": f"WITH {R.OCR_ROWS} SELECT doc_id, row_idx FROM ocr_rows WHERE NOT ({_BLANK})",
    "q_pad": f"WITH {R.OCR_ROWS} SELECT doc_id, row_idx, array_to_string(list_transform(range(1, 5), lambda i: coalesce(columns[i], '')), '¦') AS cells FROM ocr_rows",
    "q_classify": f"WITH {_CLASSIFIED} SELECT doc_id, row_idx, region, region_confidence, explanation FROM classified",
    "q_merge_headers": f"""WITH {_CLASSIFIED}, linked AS (
  SELECT *, coalesce(region = 'header' AND lag(region) OVER w = 'header' AND abs(y0 - lag(y1) OVER w) < 20, false) AS joins FROM classified WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx)
), runs AS (SELECT *, count(*) FILTER (NOT joins) OVER (PARTITION BY doc_id ORDER BY row_idx) AS run FROM linked),
placed AS (SELECT *, row_number() OVER p - 1 AS pos, lead(columns) OVER p AS next FROM runs WINDOW p AS (PARTITION BY doc_id, run ORDER BY row_idx)),
merged AS (SELECT *, CASE WHEN region = 'header' AND next IS NOT NULL THEN list_transform(columns, lambda c, i: CASE WHEN coalesce(next[i], '') <> '' THEN {trim_sql("c || ' ' || next[i]")} ELSE c END) ELSE columns END AS m FROM placed WHERE pos % 2 = 0)
SELECT doc_id, row_idx, region, CASE WHEN region = 'header' AND next IS NOT NULL THEN 'Merged fragmented header rows' ELSE explanation END AS explanation, array_to_string(m, '¦') AS cells, CASE WHEN region = 'header' THEN CASE WHEN next IS NOT NULL THEN array_to_string(m, '  ') ELSE text END END AS header_text FROM merged""",
    "q_doc_summary": f"""WITH {_CLASSIFIED} SELECT doc_id, coalesce(min(row_idx) FILTER (region IN ('header', 'data')), 0) AS table_start,
  coalesce(max(row_idx) FILTER (region IN ('header', 'data')), max(row_idx)) AS table_end, coalesce(string_agg(text, ' ' ORDER BY row_idx) FILTER (region = 'title'), '') AS title,
  coalesce(string_agg(text, '¦' ORDER BY row_idx) FILTER (region = 'metadata'), '') AS metadata,
  round((coalesce(avg(confidence) FILTER (region = 'data'), 0) + CASE WHEN count(*) FILTER (region IN ('header', 'data')) > 3 THEN 80 ELSE 50 END) / 2, 6) AS overall_confidence FROM classified GROUP BY doc_id""",
    "q_infer_schema": f"""WITH {_CLASSIFIED}, {schema_sql()} SELECT * FROM kinds""",
    "q_workspace_types": f"""WITH {R.OCR_ROWS}, widths AS (SELECT doc_id, greatest(max(len(columns)), 1) AS width FROM ocr_rows GROUP BY doc_id),
first AS (SELECT doc_id, arg_min(columns, row_idx) AS header FROM ocr_rows WHERE is_header GROUP BY doc_id),
labels AS (SELECT doc_id, col_idx, coalesce(header[col_idx + 1], 'Col ' || (col_idx + 1)) AS label FROM (SELECT doc_id, unnest(range(width)) AS col_idx FROM widths) LEFT JOIN first USING (doc_id)),
cells AS (SELECT doc_id, unnest(range(len(columns))) AS col_idx, unnest(columns) AS cell FROM ocr_rows WHERE NOT is_header),
samples AS (SELECT doc_id, col_idx, count(*) AS n, avg(CAST(regexp_matches({trim_sql('cell')}, '^[0-9]+$') AS INT)) AS whole FROM cells WHERE cell <> '' GROUP BY ALL)
SELECT doc_id, col_idx, label, coalesce({_label_case(C.WORKSPACE_LABELS)}, CASE WHEN whole > 0.7 THEN 'numeric' WHEN n > 0 THEN 'text' ELSE 'unknown' END) AS kind FROM labels LEFT JOIN samples USING (doc_id, col_idx)""",
}
