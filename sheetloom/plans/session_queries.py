"""Queries over sessions: who sees what, searches, sorts, measures, approvals, edits and exports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import access, approvals, edits, kpis
from ..operators.matching import assign
from ..sources import exports, folders, readers, recognise
from . import relations as R

OWNER = 7


def point_lookup(spark, d):
    return access.one(R.sessions(spark, d), "id", "7").select("id", "owner_id", "event_name", "status")


def member_search(spark, d):
    return access.search_members(R.members(spark, d), "R#00000001").select("id", "full_name")


def session_search(spark, d):
    return access.search_sessions(R.sessions(spark, d), "urgent").select("id", "event_name")


def rls(spark, d):
    return access.of_owned_sessions(R.match_rows(spark, d), R.sessions(spark, d), OWNER).select("session_id", "row_idx", "status")


def history(spark, d):
    s = access.newest(R.sessions(spark, d))
    return s.select("id", F.date_format("created_at", "MMM dd, yyyy").alias("shown"), access.status_label(F.col("status")).alias("label"), access.action_label(F.col("status")).alias("action"))


def top5(spark, d):
    return access.newest(R.sessions(spark, d), 5).select("id", "event_name")


def members_sorted(spark, d):
    """With the place of each, as a comparison of rows alone does not see the order."""
    return access.numbered(access.by_name(R.members(spark, d)).select("id", "full_name"))


def routing(spark, d):
    e = R.table(spark, d, "events")
    user = F.when(F.col("user_id") % 2 == 0, F.col("user_id"))
    path = F.when(F.col("event_type") == "click", "/login").otherwise("/")
    return e.select("event_id", access.route(user, path).alias("to"))


def counts(spark, d):
    return kpis.table_counts(members=R.members(spark, d), sessions=R.sessions(spark, d), attendance=R.match_rows(spark, d))


def session_kpi(spark, d):
    return kpis.session_kpis(R.match_rows(spark, d)).withColumn("progress", F.round("progress", 6))


def row_counts(spark, d):
    return kpis.row_counts(R.sessions(spark, d), R.match_rows(spark, d))


def width_histogram(spark, d):
    return kpis.histogram(R.ocr_rows(spark, d).withColumn("width", F.size("columns")), "width")


def session_defaults(spark, d):
    s = R.sessions(spark, d).withColumn("event_name", F.when(F.col("id").cast("long") % 4 == 0, "").when(F.col("id").cast("long") % 4 == 1, "  a ").when(F.col("id").cast("long") % 4 == 2, " ").otherwise(F.col("event_name")))
    named = s.withColumn("event_name", approvals.session_name(F.col("event_name"), F.col("session_date")))
    out = approvals.with_defaults(named, {"status": F.lit("pending"), "created_at": F.to_date(F.lit("2024-01-01")), "updated_at": F.to_date(F.lit("2024-01-02"))})
    return out.select("id", "event_name", "status", F.col("created_at").cast("string").alias("created_at"), F.col("updated_at").cast("string").alias("updated_at"))


def approval_filter(spark, d):
    return approvals.approved_rows(R.match_rows(spark, d)).select("session_id", "row_idx", "member_id")


def _facts(spark, d, strict):
    rows = R.match_rows(spark, d).withColumn("is_header", F.col("is_header").cast("string"))
    return approvals.attendance_of(rows, R.sessions(spark, d), strict)


def _before(spark, d):
    """Facts that stand before the approval: those of odd parts, present."""
    first = R.match_rows(spark, d).filter("member_id is not null and row_idx % 2 = 1").select("session_id", "member_id").distinct()
    return first.select("session_id", "member_id", F.to_date(F.lit("2000-01-01")).alias("attendance_date"), F.lit("before").alias("event_name"), F.lit(True).alias("present"))


def _shown(df):
    return df.withColumn("attendance_date", F.col("attendance_date").cast("string"))


def approve_upsert(spark, d):
    facts = _facts(spark, d, True).filter(F.col("session_id").cast("long") % 2 == 0)
    return _shown(approvals.upsert(_before(spark, d), facts, ["session_id", "member_id"]))


def approve_compat(spark, d):
    return _shown(_facts(spark, d, False))


def _approvals(spark, d, rows):
    """One array of rows for each session, as JSON: a member as an object, as null or not at all, marks as booleans or absent."""
    member = F.when(F.col("member_id").isNotNull(), F.concat(F.lit(',"suggestedMember":{"id":"'), "member_id", F.lit('"}'))).when(F.col("row_idx") % 2 == 0, ',"suggestedMember":null').otherwise("")
    text = F.concat(F.lit('{"idx":'), F.col("row_idx").cast("string"), F.when(F.col("is_header"), ',"isHeader":true').otherwise(""), F.when(F.col("present"), "").otherwise(',"present":false'), member, F.lit("}"))
    listed = rows.select("session_id", F.struct("row_idx", text.alias("row")).alias("r")).groupBy("session_id").agg(F.array_sort(F.collect_list("r")).alias("rs"))
    return listed.select("session_id", F.parse_json(F.concat(F.lit("["), F.array_join(F.transform("rs", lambda r: r["row"]), ","), F.lit("]"))).alias("rows"))


def approve_session(spark, d):
    s = R.sessions(spark, d).withColumn("updated_at", F.lit(None).cast("date"))
    mine = access.of_owned_sessions(R.match_rows(spark, d), s, OWNER)
    done, facts = approvals.approve(s, _approvals(spark, d, mine), _before(spark, d), OWNER, F.to_date(F.lit("2024-05-05")))
    shown = done.select("id", F.lit(None).cast("string").alias("member_id"), "status", F.col("updated_at").cast("string").alias("day"), F.lit("").alias("present"), F.to_json("final_table").alias("final_table"), F.to_json("suggested_table").alias("suggested_table"))
    return shown.unionByName(facts.select(F.col("session_id").alias("id"), "member_id", F.col("event_name").alias("status"), F.col("attendance_date").cast("string").alias("day"), F.col("present").cast("string"), F.lit(None).cast("string").alias("final_table"), F.lit(None).cast("string").alias("suggested_table")))


def variant_facts(spark, d):
    """Arrays of rows to facts, strictly, and compatibly where no member of a session has two rows. Rows are dealt by session
    once, for both ways."""
    rows, sessions = R.match_rows(spark, d).select("session_id", "row_idx", "member_id", "is_header", "present").repartition("session_id"), R.sessions(spark, d)
    strict = approvals.facts_of(_approvals(spark, d, rows), sessions)
    n = F.count("*").over(Window.partitionBy("session_id", "member_id"))
    once = rows.withColumn("n", n).filter("n = 1 or member_id is null")
    compat = approvals.facts_of(_approvals(spark, d, once), sessions, strict=False)
    return _shown(strict).withColumn("way", F.lit("strict")).unionByName(_shown(compat).withColumn("way", F.lit("compat")))


def relative_dates(spark, d):
    o = R.table(spark, d, "orders")
    then = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 1440).cast("int"))
    then = F.when(F.col("o_orderkey") % 17 == 0, F.lit("1997-06-15 12:00:00").cast("timestamp_ntz") + F.make_dt_interval(mins=(F.col("o_orderkey") % 3000 - 1500).cast("int"))).otherwise(then)
    return o.select("o_orderkey", access.distance(F.when(F.col("o_orderkey") % 1009 != 0, then), F.lit("1997-06-15 12:00:30").cast("timestamp_ntz")).alias("shown"))


def upsert_corrections(spark, d):
    base = R.corrections(spark, d).groupBy("incorrect_text").agg(F.min("corrected_member_id").alias("corrected_member_id"), F.count("*").alias("frequency"))
    batch = R.read_names(spark, d).filter("row_idx % 5 = 2").select(F.col("ocr_name").alias("incorrect_text"), F.concat(F.lit("n"), F.col("row_idx").cast("string")).alias("member_id"), F.col("row_idx").alias("seq"))
    return approvals.learn_corrections(base, batch)


def cascade_delete(spark, d):
    """A third of the owners go with their sessions, too many to broadcast."""
    s = R.sessions(spark, d)
    gone = s.filter(F.col("owner_id") % 3 == 0).select("id").hint("shuffle_hash")
    left, children = approvals.delete_cascade(s, gone, {"rows": (R.match_rows(spark, d), "session_id")})
    return left.select(F.lit("sessions").alias("of"), "id", F.lit("").alias("row_idx")).union(children["rows"].select(F.lit("rows"), "session_id", F.col("row_idx").cast("string")))


def json_bind(spark, d):
    e = R.table(spark, d, "events").select("event_id", "event_type", F.from_json("props", "k int").alias("p"), F.try_parse_json("props").alias("v"))
    s = R.sessions(spark, d).select("id", "event_name")
    bound = e.withColumn("id", F.col("p.k").cast("string")).join(s, "id")
    return bound.filter(~F.col("event_type").eqNullSafe("error")).select("event_id", "id", "event_name", F.variant_get("v", "$.k", "int").alias("k"))


def assign_member(spark, d):
    rows = R.match_rows(spark, d).select(F.col("session_id"), F.col("row_idx").cast("string").alias("row_id"), "member_id", "status").dropDuplicates(["row_id"])
    choices = R.table(spark, d, "part").select((F.lit(200000000) + F.col("p_partkey")).cast("string").alias("row_id"), F.when(F.col("p_partkey") % 4 == 0, "").when(F.col("p_partkey") % 4 == 1, "absent").otherwise((F.col("p_partkey") % 50).cast("string")).alias("member_id"))
    return assign(rows, choices, R.members(spark, d)).select("row_id", "member_id", "status")


def edit_fold(spark, d):
    return edits.fold_edits(R.edit_rows(spark, d), R.edit_log(spark, d)).select("session_id", "row_id", F.array_join("columns", "¦").alias("cells"), "is_header", "member_id", "status")


def merge_up(spark, d):
    rows = R.edit_rows(spark, d)
    merges = R.edit_log(spark, d).filter("op = 'flag'").select("session_id", "row_id")
    return edits.merge_up(rows, merges).select("session_id", "row_id", F.array_join("columns", "¦").alias("cells"))


def approve_data(spark, d):
    rows = R.match_rows(spark, d).withColumn("region", F.when(F.col("row_idx") % 3 == 0, "data").when(F.col("row_idx") % 3 == 1, "title"))
    return edits.approve_data(rows).select("session_id", "row_idx", "status")


def undo(spark, d):
    log = R.edit_log(spark, d).select("session_id", "seq", F.when(F.col("seq") % 3 == 2, "undo").when(F.col("seq") % 7 == 3, "redo").otherwise("edit").alias("op"), F.col("seq").cast("string").alias("version"))
    return edits.replay_versions(log)


def _export_rows(spark, d):
    rows = R.edit_rows(spark, d)
    cells = F.transform("columns", lambda c: F.concat(c, F.when(F.col("row_idx") % 4 == 0, F.lit('"q')).otherwise(F.lit(""))))
    return rows.withColumn("columns", cells).withColumn("region", F.when(F.col("row_idx") == 5, "footer").when(F.col("row_idx") == 1, "title").when(F.col("row_idx") < 9, "data"))


def export_csv(spark, d):
    return exports.to_csv(_export_rows(spark, d))


def export_tsv(spark, d):
    return exports.to_tsv(_export_rows(spark, d))


def clean_export(spark, d):
    rows = _export_rows(spark, d)
    return exports.to_wide(rows, exports.widest(rows))


def member_append(spark, d):
    """New members, of whom some have no department."""
    c = R.table(spark, d, "customer").filter("c_custkey % 10 = 3")
    new = c.select((F.col("c_custkey") + 1000000).alias("member_ord"), F.concat(F.lit("new"), F.col("c_custkey").cast("string")).alias("id"), F.upper("c_name").alias("full_name"), F.when(F.col("c_custkey") % 4 == 3, F.col("c_mktsegment")).alias("department"))
    out = approvals.append(R.members(spark, d), new, {"department": F.lit("none"), "aliases": F.array().cast("array<string>")})
    return out.select("member_ord", "id", "full_name", F.array_join("aliases", ",").alias("aliases"), "department", "email")


def draft_update(spark, d):
    """A draft saved again: another name and status, an unset day, for sessions of one owner; unknown ids change nothing."""
    s = R.sessions(spark, d).withColumn("session_date", F.col("session_date").cast("string"))
    mine = s.filter(F.col("owner_id") == OWNER).select("id", F.concat("event_name", F.lit(" (draft)")).alias("event_name"), F.lit("refining").alias("status"), F.lit(None).cast("string").alias("session_date"))
    changes = mine.unionByName(mine.limit(1).withColumn("id", F.lit("unknown")))
    return approvals.update(s, changes, "id").select("id", "owner_id", "event_name", "session_date", "status")


def attendance_csv(spark, d):
    """The facts as CSV files, read back."""
    path = folders.new_folder(spark, "attendance")
    exports.write_attendance(_shown(_facts(spark, d, False)), R.members(spark, d), path)
    return spark.read.option("header", True).csv(path).select("session_id", "member_id", "attendance_date", "event_name", "present", "member_name")


def roster_csv(spark, d):
    """Members as a CSV file, in another order of columns and with one that a roster has not, read back."""
    path = folders.new_folder(spark, "roster")
    m = R.members(spark, d)
    m.select(F.lower("email").alias("email"), F.col("id").alias("unused"), F.concat("full_name", F.lit(', "'), "id", F.lit('"')).alias("full_name"), "department").write.option("header", True).option("escape", '"').csv(path)
    return readers.read_roster(spark, path)


def upload_guard(spark, d):
    """Files of every kind and size by their first bytes."""
    heads = F.array(*map(F.lit, ("FFD8FFE0", "89504E470D0A1A0A00", "52494646000000005745425056", "524946460000000057415645", "474946383961", "89504E47")))
    p, k = R.table(spark, d, "part"), F.col("p_partkey")
    files = p.select(k.alias("path"), (k * 1000003 % 20000000).alias("length"), F.unhex(F.element_at(heads, (k % 6 + 1).cast("int"))).alias("content"))
    taken, rejected = readers.guard_images(readers.with_kind(files))
    return taken.select("path", "kind", F.lit(None).cast("string").alias("reason")).union(rejected.select("path", "kind", "reason"))


def enriched(spark, d):
    rows = R.match_rows(spark, d).select(F.col("session_id").cast("long").alias("doc_id"), (F.col("row_idx") % 7).cast("int").alias("row_idx"), "member_id", F.col("row_idx").alias("place"))
    return recognise.enrich(rows, R.ocr_rows(spark, d), ["doc_id", "row_idx"]).select("doc_id", "place", "member_id", F.array_join("columns", "¦").alias("cells"), F.coalesce(F.col("is_header").cast("string"), F.lit("")).alias("is_header"), F.coalesce("ocr_confidence", F.lit(-1.0)).alias("ocr_confidence"))


def recognised(spark, d):
    """A recogniser that fails on some cells; some are empty."""
    p, k = R.table(spark, d, "part"), F.col("p_partkey")
    cells = p.select(k.alias("doc_id"), F.lit(0).alias("row_idx"), F.lit(0).alias("col_idx"), F.when(k % 5 != 0, F.encode(F.concat("p_name", F.when(k % 7 == 0, F.lit("!")).otherwise(F.lit(""))), "UTF-8")).alias("image"))

    def read(image: bytes) -> tuple[str, float]:
        if image.endswith(b"!"):
            raise ValueError("unreadable")
        return image.decode().title(), float(len(image))

    return recognise.recognise(cells, read).select("doc_id", F.lower("text").alias("text"), "confidence", "is_empty")


_FACTS = f"""{R.MATCH_ROWS}, {R.SESSIONS}, facts AS (
  SELECT session_id, member_id, session_date AS attendance_date, event_name, coalesce(present, true) AS present
  FROM (SELECT * FROM match_rows WHERE NOT is_header AND member_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, member_id ORDER BY row_idx DESC) = 1) m
  JOIN sessions s ON s.id = m.session_id),
before AS (SELECT DISTINCT session_id, member_id, DATE '2000-01-01' AS attendance_date, 'before' AS event_name, true AS present FROM match_rows WHERE member_id IS NOT NULL AND row_idx % 2 = 1)"""
_JSON_ROWS = """json_rows AS (
  SELECT *, '{"idx":' || row_idx || CASE WHEN is_header THEN ',"isHeader":true' ELSE '' END || CASE WHEN present THEN '' ELSE ',"present":false' END
    || CASE WHEN member_id IS NOT NULL THEN ',"suggestedMember":{"id":"' || member_id || '"}' WHEN row_idx % 2 = 0 THEN ',"suggestedMember":null' ELSE '' END || '}' AS j FROM match_rows)"""
_EXPORT = f"""{R.EDIT_ROWS}, x AS (
  SELECT session_id, row_id, row_idx, ocr_name, is_header, list_transform(columns, lambda c: c || CASE WHEN row_idx % 4 = 0 THEN '"q' ELSE '' END) AS columns,
    CASE WHEN row_idx = 5 THEN 'footer' WHEN row_idx = 1 THEN 'title' WHEN row_idx < 9 THEN 'data' END AS region FROM edit_rows),
shown AS (SELECT * FROM x WHERE NOT is_header AND coalesce(region, '') NOT IN ('title', 'footer') AND columns IS NOT NULL)"""
_QUOTED = """array_to_string(list_transform(columns, lambda c: '"' || replace(c, '"', '""') || '"'), ',')"""

QUERIES = {
    "q_point_lookup": point_lookup, "q_member_search": member_search, "q_session_search": session_search, "q_rls_semi": rls, "q_history": history, "q_top5": top5, "q_members_sorted": members_sorted,
    "q_route": routing, "q_counts": counts, "q_session_kpi": session_kpi, "q_row_counts": row_counts, "q_width_histogram": width_histogram, "q_session_defaults": session_defaults,
    "q_approval_filter": approval_filter, "q_approve_upsert": approve_upsert, "q_approve_compat": approve_compat, "q_approve_session": approve_session, "q_variant_facts": variant_facts, "q_relative_dates": relative_dates, "q_upsert_corrections": upsert_corrections,
    "q_cascade_delete": cascade_delete, "q_json_bind": json_bind, "q_assign_member": assign_member, "q_edit_fold": edit_fold, "q_merge_up": merge_up, "q_approve_data": approve_data, "q_undo": undo,
    "q_member_append": member_append, "q_draft_update": draft_update, "q_attendance_csv": attendance_csv, "q_roster_csv": roster_csv, "q_upload_guard": upload_guard, "q_enrich": enriched, "q_recognise": recognised,
    "q_export_csv": export_csv, "q_export_tsv": export_tsv, "q_clean_export": clean_export,
}
SQL = {
    "q_point_lookup": f"WITH {R.SESSIONS} SELECT id, owner_id, event_name, status FROM sessions WHERE id = '7'",
    "q_member_search": f"WITH {R.MEMBERS} SELECT id, full_name FROM members WHERE contains(lower(full_name), 'r#00000001') OR coalesce(contains(lower(email), 'r#00000001'), false)",
    "q_session_search": f"WITH {R.SESSIONS} SELECT id, event_name FROM sessions WHERE contains(lower(event_name), 'urgent')",
    "q_rls_semi": f"WITH {R.SESSIONS}, {R.MATCH_ROWS} SELECT session_id, row_idx, status FROM match_rows m WHERE EXISTS (SELECT 1 FROM sessions s WHERE s.id = m.session_id AND s.owner_id = {OWNER})",
    "q_history": f"""WITH {R.SESSIONS} SELECT id, strftime(created_at, '%b %d, %Y') AS shown, CASE status WHEN 'approved' THEN 'Approved' WHEN 'refining' THEN 'In Review' ELSE 'Pending' END AS label,
  CASE status WHEN 'approved' THEN 'Completed' ELSE 'Continue Approval' END AS action FROM sessions ORDER BY created_at DESC NULLS FIRST, id""",
    "q_top5": f"WITH {R.SESSIONS} SELECT id, event_name FROM sessions ORDER BY created_at DESC NULLS FIRST, id LIMIT 5",
    "q_members_sorted": f"WITH {R.MEMBERS} SELECT id, full_name, row_number() OVER (ORDER BY full_name, id) AS ordinal FROM members",
    "q_route": "SELECT event_id, CASE WHEN user_id % 2 <> 0 AND event_type <> 'click' THEN '/login' WHEN user_id % 2 = 0 AND event_type = 'click' THEN '/' END AS to FROM events".replace("AS to", 'AS "to"'),
    "q_counts": "SELECT 'members' AS name, count(*) AS n FROM customer UNION ALL SELECT 'sessions', count(*) FROM orders UNION ALL SELECT 'attendance', count(*) FROM lineitem",
    "q_session_kpi": f"""WITH {R.MATCH_ROWS} SELECT session_id, count(*) AS n_rows, count(*) FILTER (status = 'correction' OR raw_override <> '') AS n_edits, count(*) FILTER (status = 'flagged') AS n_flagged,
  count(*) FILTER (is_header) AS n_headers, count(*) FILTER (NOT is_header AND member_id IS NOT NULL) AS n_identified, count(*) FILTER (NOT is_header AND member_id IS NULL) AS n_unknown,
  CAST(floor(100 * avg(CAST(coalesce(ocr_confidence, 0) > 80 AS INT)) + 0.5) AS BIGINT) AS quality_index, round(100 * avg(CAST(status = 'approved' AS INT)), 6) AS progress,
  greatest(max(n_columns), 1) AS max_columns FROM match_rows GROUP BY session_id""",
    "q_row_counts": "SELECT CAST(o_orderkey AS VARCHAR) AS id, count(l_orderkey) AS n_rows FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "q_width_histogram": f"WITH {R.OCR_ROWS} SELECT len(columns) AS width, count(*) AS n FROM ocr_rows GROUP BY 1",
    "q_session_defaults": f"""WITH {R.SESSIONS} SELECT id, CASE CAST(id AS BIGINT) % 4 WHEN 0 THEN 'Attendance — ' || strftime(session_date, '%d %b %Y') WHEN 1 THEN '  a ' WHEN 2 THEN ' ' ELSE event_name END AS event_name, status,
  CAST(coalesce(created_at, DATE '2024-01-01') AS VARCHAR) AS created_at, '2024-01-02' AS updated_at FROM sessions""",
    "q_approval_filter": f"WITH {R.MATCH_ROWS} SELECT session_id, row_idx, member_id FROM match_rows WHERE member_id IS NOT NULL AND NOT is_header",
    "q_approve_upsert": f"""WITH {_FACTS}, source AS (SELECT * FROM facts WHERE CAST(session_id AS BIGINT) % 2 = 0)
SELECT session_id, member_id, CAST(attendance_date AS VARCHAR) AS attendance_date, event_name, present FROM before ANTI JOIN source USING (session_id, member_id)
UNION ALL SELECT session_id, member_id, CAST(attendance_date AS VARCHAR), event_name, present FROM source""",
    "q_approve_compat": f"""WITH {_FACTS} SELECT session_id, member_id, CAST(attendance_date AS VARCHAR) AS attendance_date, event_name, present FROM facts
UNION ALL SELECT session_id, NULL, CAST(session_date AS VARCHAR), event_name, present FROM match_rows m JOIN sessions s ON s.id = m.session_id WHERE NOT is_header AND member_id IS NULL""",
    "q_approve_session": f"""WITH {_FACTS}, {_JSON_ROWS}, mine AS (SELECT f.* FROM facts f JOIN sessions s ON s.id = f.session_id WHERE owner_id = {OWNER}),
tables AS (SELECT session_id, '[' || string_agg(j, ',' ORDER BY row_idx, j) || ']' AS t FROM json_rows GROUP BY session_id)
SELECT id, NULL AS member_id, CASE WHEN hit THEN 'approved' ELSE status END AS status, CASE WHEN hit THEN '2024-05-05' END AS day, '' AS present, CASE WHEN hit THEN t END AS final_table, CASE WHEN hit THEN t END AS suggested_table
FROM (SELECT *, owner_id = {OWNER} AND t IS NOT NULL AS hit FROM sessions LEFT JOIN tables ON session_id = id)
UNION ALL SELECT session_id, member_id, event_name, CAST(attendance_date AS VARCHAR), CAST(present AS VARCHAR), NULL, NULL FROM before ANTI JOIN mine USING (session_id, member_id)
UNION ALL SELECT session_id, member_id, event_name, CAST(attendance_date AS VARCHAR), CAST(present AS VARCHAR), NULL, NULL FROM mine""",
    "q_variant_facts": f"""WITH {_FACTS}, {_JSON_ROWS}, once AS (SELECT * FROM json_rows WHERE member_id IS NULL OR (session_id, member_id) IN (SELECT (session_id, member_id) FROM json_rows GROUP BY session_id, member_id HAVING count(*) = 1))
SELECT session_id, member_id, CAST(attendance_date AS VARCHAR) AS attendance_date, event_name, present, 'strict' AS way FROM facts
UNION ALL SELECT session_id, member_id, CAST(session_date AS VARCHAR), event_name, coalesce(present, true), 'compat' FROM once JOIN sessions ON id = session_id WHERE NOT is_header AND (member_id IS NOT NULL OR row_idx % 2 = 0)""",
    "q_relative_dates": f"""WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN TIMESTAMP '1997-06-15 12:00:00' + to_minutes(CAST(o_orderkey % 3000 - 1500 AS BIGINT)) ELSE CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS BIGINT)) END AS t, TIMESTAMP '1997-06-15 12:00:30' AS now FROM orders),
u AS (SELECT *, floor(date_sub('second', least(t, now), greatest(t, now)) / 60 + 0.5)::BIGINT AS m, date_sub('month', least(t, now), greatest(t, now)) AS months FROM t),
w AS (SELECT *, CASE WHEN m = 0 THEN 'less than a minute' WHEN m = 1 THEN '1 minute' WHEN m < 45 THEN m || ' minutes' WHEN m < 90 THEN 'about 1 hour' WHEN m < 1440 THEN 'about ' || floor(m / 60 + 0.5)::INT || ' hours' WHEN m < 2520 THEN '1 day'
  WHEN m < 43200 THEN floor(m / 1440 + 0.5)::INT || ' days' WHEN m < 86400 THEN CASE WHEN m < 64800 THEN 'about 1 month' ELSE 'about 2 months' END WHEN months < 12 THEN floor(m / 43200 + 0.5)::INT || ' month' || CASE WHEN floor(m / 43200 + 0.5) = 1 THEN '' ELSE 's' END
  ELSE CASE WHEN months % 12 < 3 THEN 'about ' WHEN months % 12 < 9 THEN 'over ' ELSE 'almost ' END || (months // 12 + CASE WHEN months % 12 >= 9 THEN 1 ELSE 0 END) || CASE WHEN months // 12 + CASE WHEN months % 12 >= 9 THEN 1 ELSE 0 END = 1 THEN ' year' ELSE ' years' END END AS x FROM u)
SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 0 THEN NULL WHEN t > now THEN 'in ' || x ELSE x || ' ago' END AS shown FROM w""",
    "q_undo": f"""WITH RECURSIVE {R.EDIT_LOG}, log AS (
  SELECT session_id, CASE WHEN seq % 3 = 2 THEN 'undo' WHEN seq % 7 = 3 THEN 'redo' ELSE 'edit' END AS op, CAST(seq AS VARCHAR) AS version, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS k FROM edit_log
), state(session_id, k, versions, cursor) AS (
  SELECT DISTINCT session_id, CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT) FROM log
  UNION ALL SELECT s.session_id, l.k, CASE WHEN op = 'edit' THEN list_append(versions[1:cursor], version) ELSE versions END,
    CASE op WHEN 'edit' THEN cursor + 1 WHEN 'undo' THEN least(len(versions), greatest(1, cursor - 1)) ELSE least(len(versions), cursor + 1) END FROM state s JOIN log l ON l.session_id = s.session_id AND l.k = s.k + 1
) SELECT session_id, versions[cursor] AS version, CAST(len(versions) AS BIGINT) AS n_versions FROM state QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY k DESC) = 1""",
    "q_member_append": f"""WITH {R.MEMBERS} SELECT member_ord, id, full_name, array_to_string(aliases, ',') AS aliases, department, email FROM members
UNION ALL SELECT c_custkey + 1000000, 'new' || c_custkey, upper(c_name), '', CASE WHEN c_custkey % 4 = 3 THEN c_mktsegment ELSE 'none' END, NULL FROM customer WHERE c_custkey % 10 = 3""",
    "q_draft_update": f"""WITH {R.SESSIONS} SELECT id, owner_id, CASE WHEN owner_id = {OWNER} THEN event_name || ' (draft)' ELSE event_name END AS event_name,
  CASE WHEN owner_id <> {OWNER} THEN CAST(session_date AS VARCHAR) END AS session_date, CASE WHEN owner_id = {OWNER} THEN 'refining' ELSE status END AS status FROM sessions""",
    "q_attendance_csv": f"""WITH {_FACTS}, {R.MEMBERS}, every AS (SELECT * FROM facts UNION ALL SELECT session_id, NULL, session_date, event_name, present FROM match_rows m JOIN sessions s ON s.id = m.session_id WHERE NOT is_header AND member_id IS NULL)
SELECT session_id, member_id, CAST(attendance_date AS VARCHAR) AS attendance_date, event_name, CAST(present AS VARCHAR) AS present, full_name AS member_name FROM every LEFT JOIN members ON id = member_id""",
    "q_roster_csv": f"""WITH {R.MEMBERS} SELECT full_name || ', "' || id || '"' AS full_name, NULL AS aliases, department, NULL AS phone, lower(email) AS email FROM members""",
    "q_upload_guard": """SELECT p_partkey AS path, CASE p_partkey % 6 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' END AS kind,
  CASE WHEN p_partkey % 6 > 2 THEN 'not a JPEG, PNG or WebP image' WHEN p_partkey * 1000003 % 20000000 > 10485760 THEN 'larger than 10 MB' END AS reason FROM part""",
    "q_enrich": f"""WITH {R.MATCH_ROWS}, {R.OCR_ROWS} SELECT CAST(m.session_id AS BIGINT) AS doc_id, m.row_idx AS place, member_id, array_to_string(columns, '¦') AS cells, coalesce(CAST(o.is_header AS VARCHAR), '') AS is_header, coalesce(confidence, -1.0::DOUBLE) AS ocr_confidence
FROM match_rows m LEFT JOIN ocr_rows o ON o.doc_id = CAST(m.session_id AS BIGINT) AND o.row_idx = m.row_idx % 7""",
    "q_recognise": """SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN '' ELSE lower(p_name) END AS text,
  CASE WHEN p_partkey % 5 = 0 THEN 100 WHEN p_partkey % 7 = 0 THEN 0 ELSE strlen(p_name) END::DOUBLE AS confidence, p_partkey % 5 = 0 AS is_empty FROM part""",
    "q_upsert_corrections": f"""WITH {R.ROSTER}, {R.READ_NAMES}, {R.CORRECTIONS}, base AS (SELECT incorrect_text, min(corrected_member_id) AS m, count(*) AS f FROM corrections GROUP BY 1),
new AS (SELECT ocr_name AS incorrect_text, max_by('n' || row_idx, row_idx) AS m, count(*) AS n FROM read_names WHERE row_idx % 5 = 2 GROUP BY 1)
SELECT incorrect_text, coalesce(new.m, base.m) AS corrected_member_id, coalesce(f, 0) + coalesce(n, 0) AS frequency FROM base FULL JOIN new USING (incorrect_text)""",
    "q_cascade_delete": f"""WITH {R.MATCH_ROWS} SELECT 'sessions' AS "of", CAST(o_orderkey AS VARCHAR) AS id, '' AS row_idx FROM orders WHERE o_custkey % 3 <> 0
UNION ALL SELECT 'rows', session_id, CAST(row_idx AS VARCHAR) FROM match_rows WHERE session_id NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 3 = 0)""",
    "q_json_bind": f"""WITH {R.SESSIONS} SELECT event_id, id, event_name, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events JOIN sessions ON id = json_extract_string(props, '$.k') WHERE event_type IS DISTINCT FROM 'error'""",
    "q_assign_member": f"""WITH {R.MATCH_ROWS}, {R.MEMBERS}, choices AS (
  SELECT CAST(200000000 + p_partkey AS VARCHAR) AS row_id, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'absent' ELSE CAST(p_partkey % 50 AS VARCHAR) END AS member_id FROM part)
SELECT row_id, m.id AS member_id, CASE WHEN c.member_id <> '' THEN 'correction' ELSE 'none' END AS status FROM choices c SEMI JOIN match_rows r ON CAST(r.row_idx AS VARCHAR) = c.row_id LEFT JOIN members m ON m.id = c.member_id""",
    "q_edit_fold": f"""WITH {R.EDIT_ROWS}, {R.EDIT_LOG}, cell AS (SELECT session_id, row_id, col_idx, max_by(value, seq) AS value FROM edit_log WHERE op = 'edit_cell' GROUP BY ALL),
cells AS (SELECT session_id, row_id, max(col_idx) AS last, map_from_entries(list((col_idx, value))) AS m FROM cell GROUP BY ALL),
st AS (SELECT session_id, row_id, max_by(CASE op WHEN 'approve' THEN 'approved' WHEN 'flag' THEN 'flagged' WHEN 'edit_cell' THEN 'correction' ELSE CASE WHEN value <> '' THEN 'correction' ELSE 'none' END END, seq) AS s
  FROM edit_log WHERE op IN ('approve', 'flag', 'edit_cell', 'assign_member') GROUP BY ALL),
mem AS (SELECT session_id, row_id, nullif(max_by(value, seq), '') AS member FROM edit_log WHERE op = 'assign_member' GROUP BY ALL),
rest AS (SELECT session_id, row_id, count(*) FILTER (op = 'toggle_header') % 2 = 1 AS flip, count(*) FILTER (op = 'delete') > 0 AS gone FROM edit_log GROUP BY ALL)
SELECT r.session_id, r.row_id, array_to_string(CASE WHEN m IS NULL THEN columns ELSE list_transform(range(greatest(len(coalesce(columns, [ocr_name])), last + 1)), lambda i: coalesce(m[i], coalesce(columns, [ocr_name])[i + 1])) END, '¦') AS cells,
  is_header <> coalesce(flip, false) AS is_header, member AS member_id, coalesce(s, status) AS status
FROM edit_rows r LEFT JOIN cells USING (session_id, row_id) LEFT JOIN st USING (session_id, row_id) LEFT JOIN mem USING (session_id, row_id) LEFT JOIN rest USING (session_id, row_id) WHERE NOT coalesce(gone, false)""",
    "q_merge_up": f"""WITH {R.EDIT_ROWS}, {R.EDIT_LOG}, ups AS (SELECT DISTINCT session_id, row_id FROM edit_log WHERE op = 'flag'),
marked AS (SELECT r.*, u.row_id IS NOT NULL AND r.row_idx > 0 AS up FROM edit_rows r LEFT JOIN ups u ON u.session_id = r.session_id AND u.row_id = r.row_id),
placed AS (SELECT *, count(*) FILTER (NOT up) OVER (PARTITION BY session_id ORDER BY row_idx) AS block FROM marked)
SELECT session_id, min_by(row_id, row_idx) AS row_id, array_to_string(flatten(list(coalesce(columns, []) ORDER BY row_idx)), '¦') AS cells FROM placed GROUP BY session_id, block""",
    "q_approve_data": f"WITH {R.MATCH_ROWS} SELECT session_id, row_idx, CASE WHEN row_idx % 3 = 0 THEN 'approved' ELSE status END AS status FROM match_rows",
    "q_export_csv": f"""WITH {_EXPORT}, lines AS (SELECT session_id, -1 AS k, {_QUOTED} AS line FROM x WHERE is_header QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY row_idx) = 1
  UNION ALL SELECT session_id, row_idx, {_QUOTED} FROM shown) SELECT session_id, string_agg(line, chr(10) ORDER BY k) || chr(10) AS csv FROM lines GROUP BY 1""",
    "q_export_tsv": f"""WITH {_EXPORT}, lines AS (SELECT session_id, -1 AS k, columns FROM x WHERE is_header QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY row_idx) = 1
  UNION ALL SELECT session_id, row_idx, columns FROM shown) SELECT session_id, string_agg(array_to_string(columns, chr(9)), chr(10) ORDER BY k) || chr(10) AS tsv FROM lines GROUP BY 1""",
    "q_clean_export": f"""WITH {_EXPORT}, c AS (SELECT session_id, row_idx, coalesce(columns, [ocr_name]) AS c FROM x) SELECT session_id, row_idx, c[1] AS "A", c[2] AS "B", c[3] AS "C" FROM c""",
}
