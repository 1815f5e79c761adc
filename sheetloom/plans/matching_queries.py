"""Queries of the matching operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching
from . import relations as R


def _shown(df):
    return df.select("row_idx", "ocr_name", "member_id", F.round("confidence", 6).alias("confidence"), "status")


def match_cascade(spark, d):
    return _shown(matching.cascade(R.read_names(spark, d), R.roster(spark, d), R.corrections(spark, d), with_fuzzy=False))


def full_cascade(spark, d):
    return _shown(matching.cascade(R.read_names(spark, d), R.roster(spark, d), R.corrections(spark, d)))


def fuzzy_match(spark, d):
    texts = R.read_names(spark, d).select(F.lower("ocr_name").alias("t"))
    return matching.fuzzy(texts, R.roster(spark, d)).select("t", "member_id", F.round("score", 6).alias("score"))


def exact_match(spark, d):
    """Texts as short as an id are matched by what the id contains."""
    texts = R.table(spark, d, "part").select(F.concat(F.lit("n"), (F.col("p_partkey") % 70).cast("string")).alias("t"))
    return matching.exact(texts, R.roster(spark, d))


def correction_lookup(spark, d):
    return matching.learned(R.corrections(spark, d), R.roster(spark, d))


_EXACT = """
keys AS (SELECT lower(full_name) AS name, 0 AS kind, member_ord, id FROM roster UNION ALL SELECT lower(unnest(aliases)), 1, member_ord, id FROM roster),
texts AS (SELECT DISTINCT lower(ocr_name) AS t FROM read_names),
learned AS (SELECT t, m AS member_id FROM (SELECT lower(incorrect_text) AS t, max_by(corrected_member_id, ord) AS m FROM corrections GROUP BY 1) SEMI JOIN roster ON roster.id = m),
exact AS (SELECT t, arg_min(id, member_ord) AS member_id FROM texts JOIN keys ON t = name OR contains(lower(id), t) GROUP BY t)"""
_BASE = ",\n".join([R.ROSTER, R.READ_NAMES, R.CORRECTIONS])

# the least edits to a part of a name: over all its parts
_FUZZY = """
parts AS (SELECT DISTINCT name, substr(name, i, n) AS part FROM (SELECT name, i, unnest(range(0, len(name) - i + 2)) AS n FROM (SELECT name, unnest(range(1, len(name) + 1)) AS i FROM keys))),
edits AS (SELECT t, name, min(levenshtein(t, part)) AS e FROM texts, parts WHERE t <> '' GROUP BY t, name),
near AS (
  SELECT t, member_ord, id, min(e) FILTER (kind = 0) AS e0, min(e) FILTER (kind = 1) AS e1 FROM edits JOIN keys USING (name) WHERE e <= 0.35 * len(t) GROUP BY t, member_ord, id),
fuzzy AS (
  SELECT t, n.id AS member_id, CASE WHEN e0 IS NULL THEN 1 ELSE pow(greatest(e0 / CAST(len(t) AS DOUBLE), pow(2::DOUBLE, -52)), 0.7::DOUBLE) END * CASE WHEN e1 IS NULL THEN 1 ELSE pow(greatest(e1 / CAST(len(t) AS DOUBLE), pow(2::DOUBLE, -52)), 0.3::DOUBLE) END AS score
  FROM near n JOIN roster r ON r.id = n.id QUALIFY row_number() OVER (PARTITION BY t ORDER BY score, levenshtein(t, lower(full_name)), n.member_ord) = 1)"""

QUERIES = {"q_match_cascade": match_cascade, "q_full_cascade": full_cascade, "q_fuzzy_match": fuzzy_match, "q_exact_match": exact_match, "q_correction_lookup": correction_lookup}
SQL = {
    "q_match_cascade": f"""WITH {_BASE}, {_EXACT}
SELECT row_idx, ocr_name, coalesce(l.member_id, e.member_id) AS member_id, CASE WHEN coalesce(l.member_id, e.member_id) IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
  CASE WHEN l.member_id IS NOT NULL THEN 'correction' WHEN e.member_id IS NOT NULL THEN 'exact' ELSE 'none' END AS status
FROM read_names LEFT JOIN learned l ON l.t = lower(ocr_name) LEFT JOIN exact e ON e.t = lower(ocr_name)""",
    "q_full_cascade": f"""WITH {_BASE}, {_EXACT}, {_FUZZY}
SELECT row_idx, ocr_name, coalesce(l.member_id, e.member_id, f.member_id) AS member_id,
  round(CASE WHEN coalesce(l.member_id, e.member_id) IS NOT NULL THEN 1.0::DOUBLE WHEN f.member_id IS NOT NULL THEN 1 - score ELSE 0.0::DOUBLE END, 6) AS confidence,
  CASE WHEN l.member_id IS NOT NULL THEN 'correction' WHEN e.member_id IS NOT NULL THEN 'exact' WHEN f.member_id IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS status
FROM read_names LEFT JOIN learned l ON l.t = lower(ocr_name) LEFT JOIN exact e ON e.t = lower(ocr_name) LEFT JOIN fuzzy f ON f.t = lower(ocr_name)""",
    "q_fuzzy_match": f"""WITH {_BASE}, {_EXACT}, {_FUZZY} SELECT t, member_id, round(score, 6) AS score FROM fuzzy""",
    "q_exact_match": f"""WITH {R.ROSTER}, texts AS (SELECT DISTINCT 'n' || p_partkey % 70 AS t FROM part)
SELECT t, arg_min(id, member_ord) AS member_id FROM texts JOIN roster ON contains(lower(id), t) OR lower(full_name) = t OR list_contains(aliases, t) GROUP BY t""",
    "q_correction_lookup": f"""WITH {_BASE}
SELECT t, m AS member_id FROM (SELECT lower(incorrect_text) AS t, max_by(corrected_member_id, ord) AS m FROM corrections GROUP BY 1) SEMI JOIN roster ON roster.id = m""",
}
