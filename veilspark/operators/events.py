"""Audit event log: rows of what happened, and queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import audit, store

SEVERITIES = ("low", "medium", "high", "critical")


def event_rows(rows: DataFrame, event_type: Column, severity: Column, details: Column, key: str, stamp: str, session: str = "session_id", user: str = "user_id") -> DataFrame:
    """(id, event_type, severity, session_id, user_id, details, occurred_at) to append to the log; details become JSON without sensitive fields' values."""
    return rows.select(
        F.col(key).cast("bigint").alias("id"), event_type.alias("event_type"), F.lower(severity).alias("severity"), F.col(session).alias("session_id"),
        F.col(user).alias("user_id"), F.to_json(details).alias("details"), F.col(stamp).alias("occurred_at"),
    )


def query_events(log: DataFrame, start: Column | None = None, end: Column | None = None, least_severity: str | None = None, limit: int | None = None, offset: int = 0, **equal) -> DataFrame:
    """Newest events first that meet every given condition; a severity takes all at or above it."""
    rows = audit.matching(log, "occurred_at", start, end, **equal)
    if least_severity:
        rows = rows.where(F.col("severity").isin(list(SEVERITIES[SEVERITIES.index(least_severity) :])))
    return rows if limit is None else store.newest(rows, "occurred_at", "id", limit, offset)
