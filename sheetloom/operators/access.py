"""Who sees which rows, lookups, searches and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written


def owned(sessions: DataFrame, user) -> DataFrame:
    return sessions.filter(F.col("owner_id") == user)


def of_owned_sessions(rows: DataFrame, sessions: DataFrame, user, key: str = "session_id") -> DataFrame:
    """Rows that belong to a session of the user; a null key belongs to none."""
    return rows.join(owned(sessions, user).select(F.col("id").alias(key)), key, "left_semi")


def one(table: DataFrame, key: str, value) -> DataFrame:
    """The row of a key; an error unless there is exactly one."""
    found = table.filter(F.col(key) == value)
    n = found.limit(2).count()
    if n != 1:
        raise LookupError(f"{'no' if n == 0 else 'more than one'} row where {key} = {value}")
    return found


def holds(c: Column | str, needle: str) -> Column:
    """Whether text contains the needle, in any case; null does not, unless the needle is empty."""
    return F.coalesce(F.contains(F.lower(F.col(c) if isinstance(c, str) else c), F.lower(F.lit(needle))), F.lit(False))


def search_members(members: DataFrame, needle: str) -> DataFrame:
    return members if not needle else members.filter(holds("full_name", needle) | holds("email", needle))


def search_sessions(sessions: DataFrame, needle: str) -> DataFrame:
    return sessions if not needle else sessions.filter(holds("event_name", needle))


def newest(sessions: DataFrame, most: int | None = None) -> DataFrame:
    """By created_at, latest first and null before all; with a limit Spark keeps only the top rows of each task."""
    ordered = sessions.orderBy(F.col("created_at").desc_nulls_first(), F.col("id").asc())
    return ordered if most is None else ordered.limit(most)


def by_name(members: DataFrame, collation: str = "UNICODE") -> DataFrame:
    """In the order of a database's collation, where accents and case count after letters; null last, then by id."""
    return members.orderBy(F.collate("full_name", collation).asc_nulls_last(), F.col("id").asc())


def numbered(ordered: DataFrame, name: str = "ordinal") -> DataFrame:
    """Adds the place of each row of an ordered DataFrame, from 1. Ranges are written with the place within each, and the sizes
    of ranges, a row for each, say where they begin; no task sees more than its range."""
    within = F.monotonically_increasing_id()
    rows = written(ordered.withColumn("at__", within), "numbered").withColumn("range__", F.shiftright("at__", 33))
    sizes = rows.groupBy("range__").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = sizes.withColumn("begin__", before).drop("n")
    return rows.join(F.broadcast(begins), "range__").withColumn(name, F.col("begin__") + F.col("at__").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("at__", "range__", "begin__")


def status_label(status: Column) -> Column:
    """The badge that a list of sessions shows for a status."""
    return F.when(status == "approved", "Approved").when(status == "refining", "In Review").otherwise("Pending")


def action_label(status: Column) -> Column:
    """What a list of sessions says is left to do."""
    return F.when(status == "approved", "Completed").otherwise("Continue Approval")


def distance(then: Column, now: Column) -> Column:
    """How long ago `then` was, in words, or how far ahead; null for null. Minutes and days are rounded, halves up; from two months of
    30 days on, full calendar months and years count."""
    early, late = F.least(then, now), F.greatest(then, now)
    seconds = F.timestamp_diff("SECOND", early, late)
    minutes = F.floor(seconds / 60 + 0.5)
    over = lambda n: F.floor(minutes / n + 0.5).cast("string")
    months = F.timestamp_diff("MONTH", early, late)
    years = F.floor(months / 12)
    many = lambda n, unit: F.concat(n.cast("string"), F.when(n == 1, f" {unit}").otherwise(f" {unit}s"))
    day, month = 1440, 43200
    # fixed values: the steps and their words
    words = (
        F.when(minutes == 0, "less than a minute").when(minutes < 45, many(minutes, "minute")).when(minutes < 90, "about 1 hour").when(minutes < day, F.concat(F.lit("about "), over(60), F.lit(" hours")))
        .when(minutes < 2520, "1 day").when(minutes < month, F.concat(over(day), F.lit(" days"))).when(minutes < 1.5 * month, "about 1 month").when(minutes < 2 * month, "about 2 months")
        .when(months < 12, many(F.floor(minutes / month + 0.5), "month")).when(months % 12 < 3, F.concat(F.lit("about "), many(years, "year"))).when(months % 12 < 9, F.concat(F.lit("over "), many(years, "year")))
        .otherwise(F.concat(F.lit("almost "), many(years + 1, "year")))
    )
    return F.when(then > now, F.concat(F.lit("in "), words)).when(then <= now, F.concat(words, F.lit(" ago")))


def route(user: Column, path: Column) -> Column:
    """Where a request is sent: the login page without a user, the start page from the login page with one."""
    return F.when(user.isNull() & (path != "/login"), "/login").when(user.isNotNull() & (path == "/login"), "/")
