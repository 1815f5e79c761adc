"""The log of hand edits, folded into rows: each edit has a sequence number, and rows have ids that never change."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def fold_edits(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """rows: session_id, row_id, ocr_name, columns, is_header, member_id, status. edits: session_id, row_id, seq, op, col_idx,
    value; op is one of edit_cell, assign_member, approve, flag, toggle_header, delete.

    The last value of each cell stays, as does the last member; the last edit but a toggle sets the status; toggles count
    by parity; a delete at any time removes the row. Edits are folded by partial aggregates, then joined once."""
    cells = edits.filter("op = 'edit_cell'").groupBy("session_id", "row_id", "col_idx").agg(F.max_by("value", "seq").alias("value"))
    cells = cells.groupBy("session_id", "row_id").agg(F.map_from_entries(F.collect_list(F.struct("col_idx", "value"))).alias("cells"))
    is_op = lambda *ops: F.col("op").isin(*ops)
    status = F.when(is_op("approve"), "approved").when(is_op("flag"), "flagged").when(is_op("edit_cell"), "correction").when(is_op("assign_member"), F.when(F.coalesce("value", F.lit("")) != "", "correction").otherwise("none"))
    rest = edits.groupBy("session_id", "row_id").agg(
        F.max_by(F.when(status.isNotNull(), status), F.when(status.isNotNull(), F.col("seq"))).alias("new_status"),
        F.max(F.when(is_op("assign_member"), F.struct("seq", F.nullif("value", F.lit("")).alias("value")))).alias("member"),
        (F.count_if(is_op("toggle_header")) % 2 == 1).alias("flip"),
        (F.count_if(is_op("delete")) > 0).alias("gone"),
    )
    keys = ["session_id", "row_id"]
    out = rows.join(rest, keys, "left").filter(~F.coalesce("gone", F.lit(False))).join(cells, keys, "left")
    base = F.coalesce("columns", F.array("ocr_name"))
    last = F.greatest(F.size(base) - 1, F.coalesce(F.array_max(F.map_keys("cells")), F.lit(-1)))
    edited = F.transform(F.sequence(F.lit(0), last), lambda i: F.coalesce(F.element_at("cells", i), F.get(base, i)))
    return out.withColumns(
        {
            "columns": F.when(F.col("cells").isNotNull(), edited).otherwise(F.col("columns")),
            "member_id": F.when(F.col("member").isNotNull(), F.col("member.value")).otherwise(F.col("member_id")),
            "status": F.coalesce("new_status", "status"),
            "is_header": F.coalesce("is_header", F.lit(False)) != F.coalesce("flip", F.lit(False)),
        }
    ).select(*rows.columns)


def merge_up(rows: DataFrame, merges: DataFrame) -> DataFrame:
    """Rows named by merges (session_id, row_id) add their cells to the nearest row above that stays, which keeps all
    else; the first row of a session stays. A row without cells adds none."""
    marked = rows.join(merges.select("session_id", "row_id", F.lit(True).alias("up")).distinct(), ["session_id", "row_id"], "left")
    order = Window.partitionBy("session_id").orderBy("row_idx")
    marked = marked.withColumn("up", F.coalesce("up", F.lit(False)) & (F.row_number().over(order) > 1))
    marked = marked.withColumn("block", F.count_if(~F.col("up")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cells = marked.groupBy("session_id", "block").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("row_idx", F.coalesce("columns", F.array().cast("array<string>")).alias("columns")))), lambda s: s["columns"])).alias("all_cells"))
    kept = marked.filter(~F.col("up")).join(cells, ["session_id", "block"])
    return kept.withColumn("columns", F.col("all_cells")).select(*rows.columns)


def approve_data(rows: DataFrame) -> DataFrame:
    """All rows of the region data become approved; rows without a region do not."""
    return rows.withColumn("status", F.when(F.col("region") == "data", "approved").otherwise(F.col("status")))


def replay_versions(log: DataFrame) -> DataFrame:
    """log: session_id, seq, op (edit, undo or redo), version. An edit drops all versions after the cursor and adds its
    own; undo and redo move the cursor as far as there are versions. Returns session_id, version (null if none) and
    n_versions. Each session's log is replayed in order, which has no built-in form; it streams through its task, which
    holds the versions of one session alone."""

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["session_id", "version", "n_versions"]
        session, versions, at, done = None, None, -1, []
        result = lambda: (session, versions[at] if versions else None, len(versions))
        for batch in batches:
            for own, op, version in batch.itertuples(index=False):
                if versions is None or own != session:
                    if versions is not None:
                        done.append(result())
                    session, versions, at = own, [], -1
                if op == "edit":
                    del versions[at + 1 :]
                    versions.append(version)
                    at += 1
                elif op == "undo":
                    at = max(0, at - 1) if versions else -1
                elif op == "redo":
                    at = min(len(versions) - 1, at + 1)
            yield pd.DataFrame(done, columns=names)
            done = []
        if versions is not None:
            yield pd.DataFrame([result()], columns=names)

    ordered = log.filter("session_id is not null").repartition("session_id").sortWithinPartitions("session_id", "seq")
    return ordered.select("session_id", "op", "version").mapInPandas(replay, "session_id string, version string, n_versions long")
