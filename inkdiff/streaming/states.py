"""Session states from a stream of audit events: an extra, beside the batch form in operators.logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def current_states(events: DataFrame) -> DataFrame:
    """For a stream of (session_id, seq, state): each session's latest state. To be written in update or complete mode."""
    return events.groupBy("session_id").agg(F.max_by("state", "seq").alias("state"), F.count("*").alias("transitions"))


def active_users(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """For a stream of (user_id, created_at): about how many users are active in each window; late rows wait for `late`."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", width)).agg(F.approx_count_distinct("user_id").alias("users"))
