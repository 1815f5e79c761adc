"""Approving sessions: attendance facts by upsert, learned corrections, defaults, and deletes that cascade.

A DataFrame cannot overwrite the files it reads: write the result to a new place, then swap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def approved_rows(rows: DataFrame) -> DataFrame:
    """Rows with a member that are no headers."""
    return rows.filter(F.col("member_id").isNotNull() & ~F.coalesce("is_header", F.lit(False)))


def with_defaults(table: DataFrame, defaults: dict) -> DataFrame:
    """Column defaults where a value is null; absent columns are added."""
    return table.withColumns({c: F.coalesce(c, d) if c in table.columns else d for c, d in defaults.items()})


def append(table: DataFrame, rows: DataFrame, defaults: dict) -> DataFrame:
    """The table and new rows, which get the defaults of columns that they lack or leave null."""
    given = with_defaults(rows, defaults)
    absent = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema if f.name not in given.columns]
    return table.unionByName(given.select("*", *absent).select(*table.columns))


def update(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of the table with the values of the row of changes that has their key (one at most), nulls too; other columns and
    rows stay, and a key that the table does not hold changes nothing."""
    new = [c for c in changes.columns if c != key]
    hit = changes.select(key, *(F.col(c).alias(f"{c}__new") for c in new), F.lit(True).alias("hit__"))
    return table.join(hit, key, "left").select(*(F.when(F.col("hit__"), F.col(f"{c}__new")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns))


def session_name(name, date):
    """The name as it stands, or one from the date if it is null or empty; blanks are a name."""
    return F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Attendance — "), F.date_format(date, "dd MMM yyyy")))


def attendance_of(rows: DataFrame, sessions: DataFrame, strict: bool = True) -> DataFrame:
    """Attendance facts of approved sessions. rows: session_id, row_idx, member_id, is_header (text), present (nullable).

    strict: rows without a member drop, and of several rows of a member the last counts. Otherwise rows without a member
    stay, each a fact of its own."""
    kept = rows.filter(~F.coalesce(F.col("is_header").eqNullSafe("true"), F.lit(False)))
    last = Window.partitionBy("session_id", "member_id").orderBy(F.desc("row_idx"))
    ranked = kept.filter("member_id is not null").withColumn("k", F.row_number().over(last)).filter("k = 1").drop("k")
    return _dated(ranked if strict else ranked.unionByName(kept.filter("member_id is null")), sessions)


def _dated(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """Facts with the day and name of their session."""
    return facts.join(sessions.select(F.col("id").alias("session_id"), "event_name", F.col("session_date").alias("attendance_date")), "session_id").select(
        "session_id", "member_id", "attendance_date", "event_name", F.coalesce("present", F.lit(True)).alias("present")
    )


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows of equal keys; keys that hold a null never meet."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def rows_of(approvals: DataFrame) -> DataFrame:
    """The rows of approvals (session_id, rows: a VARIANT array) one by one: session_id, pos, member_id, has_member (a member was
    given, be it JSON null), is_header (text) and present. A member that is missing is told from one that is null."""
    spark = approvals.sparkSession
    each = approvals.select("session_id", "rows").lateralJoin(spark.tvf.variant_explode(F.col("rows").outer()))
    text = lambda path: F.try_variant_get("value", path, "string")
    return each.select(
        "session_id",
        "pos",
        text("$.suggestedMember.id").alias("member_id"),
        F.try_variant_get("value", "$.suggestedMember", "variant").isNotNull().alias("has_member"),
        text("$.isHeader").alias("is_header"),
        text("$.present").cast("boolean").alias("present"),
    )


def facts_of(approvals: DataFrame, sessions: DataFrame, strict: bool = True) -> DataFrame:
    """Attendance facts of the rows of approvals, with the day and name of their session.

    strict: rows without a member's id drop, and of several rows of a member the last counts. Otherwise rows whose member is
    JSON null stay, each a fact without a member, rows that lack the member drop, and two rows of one member of a session
    raise an error."""
    rows = rows_of(approvals).filter(F.col("has_member") & ~F.col("is_header").eqNullSafe("true")).withColumn("row_idx", F.col("pos"))
    if strict:
        return attendance_of(rows, sessions)
    rows = rows.withColumn("n", F.count("*").over(Window.partitionBy("session_id", "member_id")))
    twice = F.col("member_id").isNotNull() & (F.col("n") > 1)
    once = rows.filter(F.when(twice, F.raise_error(F.concat(F.lit("two rows of member "), "member_id", F.lit(" in session "), "session_id"))).otherwise(F.lit(True)).cast("boolean"))
    return _dated(once, sessions)  # each member has one row, so none is left to choose


def approve(sessions: DataFrame, approvals: DataFrame, attendance: DataFrame, owner, now, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Sessions and attendance after approvals (session_id, rows: a VARIANT array; one for a session).

    An approved session has the rows as final_table and suggested_table, the status approved and `now` as updated_at; its
    facts (see facts_of) replace those of the same session and member. A session that is absent or not owned by `owner` is
    an error, which the plans of both results raise themselves, so that no job beforehand is needed."""
    asked = approvals.select(F.col("session_id").alias("id"), "rows", F.lit(True).alias("asked"))
    refused = lambda: F.raise_error(F.concat(F.lit("session not found or not owned: "), "id"))
    allowed = F.when(F.col("asked") & ~F.col("owner_id").eqNullSafe(F.lit(owner)), refused()).otherwise(F.lit(True)).cast("boolean")
    done = sessions.join(asked, "id", "full_outer").filter(allowed)
    new = {"status": F.lit("approved"), "updated_at": now, "final_table": F.col("rows"), "suggested_table": F.col("rows")}
    present = [c for c in new if c not in sessions.columns]
    done = done.withColumns({c: F.when(F.col("asked"), v).otherwise(F.col(c) if c in sessions.columns else F.lit(None)) for c, v in new.items()})
    owned = asked.join(sessions.select("id", "owner_id", "event_name", "session_date"), "id", "left").filter(allowed)
    facts = facts_of(owned.select(F.col("id").alias("session_id"), "rows"), owned, strict)
    return done.select(*sessions.columns, *present), upsert(attendance, facts, ["session_id", "member_id"])


def learn_corrections(corrections: DataFrame, batch: DataFrame) -> DataFrame:
    """corrections: incorrect_text, corrected_member_id, frequency. batch: incorrect_text, member_id, seq. The last member
    of a text stays, and its frequency grows by the rows of the batch."""
    new = batch.groupBy("incorrect_text").agg(F.max_by("member_id", "seq").alias("member_id"), F.count("*").alias("n"))
    return corrections.join(new, "incorrect_text", "full_outer").select(
        "incorrect_text", F.coalesce("member_id", "corrected_member_id").alias("corrected_member_id"), (F.coalesce("frequency", F.lit(0)) + F.coalesce("n", F.lit(0))).cast("long").alias("frequency")
    )


def delete_cascade(parents: DataFrame, gone: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    """Parents without the ids in `gone`, and each child table (with its foreign key) without rows of these. Few ids are broadcast
    by their size. For many, give `gone` the hint shuffle_hash, which reaches the joins: a task then holds its share of the
    ids, each once, and lets rows pass, where a merge join sorts the rows too."""
    ids = gone.select("id").distinct()
    left = {name: child.join(ids.withColumnRenamed("id", key), key, "left_anti").select(*child.columns) for name, (child, key) in children.items()}
    return parents.join(ids, "id", "left_anti").select(*parents.columns), left


def delete_session(sessions: DataFrame, session_id, children: dict[str, tuple[DataFrame, str]]) -> tuple[DataFrame, dict[str, DataFrame]]:
    return delete_cascade(sessions, sessions.filter(F.col("id") == session_id).select("id"), children)
