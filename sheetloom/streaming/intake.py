"""Approved rows that arrive as files, turned into facts batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.approvals import attendance_of


def take_in(rows: DataFrame, sessions: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """rows: a stream of session_id, row_idx, member_id, is_header, present. Each batch's facts go to `upsert` with the
    number of the batch; keyed by session and member, a batch that runs again after a failure changes nothing."""
    return rows.writeStream.foreachBatch(lambda df, number: upsert(attendance_of(df, sessions), number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
