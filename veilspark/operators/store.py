"""Sessions, mappings and detections as DataFrames: lookups, upserts, deletes, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one with the greatest values of ``order``; every column stays.

    A plain aggregation: rows of one key are reduced before the shuffle, however many there are.
    """
    best = F.max_by(F.struct(*rows.columns), F.struct(*order))
    return rows.groupBy(*keys).agg(best.alias("_row")).select("_row.*")


def upsert_sessions(sessions: DataFrame, changes: DataFrame) -> DataFrame:
    """Sessions after applying changes; a known id takes over ``expires_at`` only.

    Of several changes to one id the latest by ``created_at`` counts.
    """
    last = latest_per_key(changes, ["session_id"], ["created_at", "expires_at"])
    fresh = last.select(*[F.col(c).alias(f"_new_{c}") for c in sessions.columns])
    joined = sessions.join(fresh, F.col("session_id") == F.col("_new_session_id"), "full_outer")
    known = F.col("session_id").isNotNull()
    return joined.select(
        *[
            F.when(known & F.col("_new_session_id").isNotNull() & F.lit(c == "expires_at"), F.col(f"_new_{c}")).when(known, F.col(c)).otherwise(F.col(f"_new_{c}")).alias(c)
            for c in sessions.columns
        ]
    )


def mapping_rows(anonymized: DataFrame, session_col: str, entries_col: str) -> DataFrame:
    """(session_id, position, placeholder, original, entity_type): mapping entries as rows to append."""
    from veilspark.functions.rewrite import type_of_placeholder

    return anonymized.select(F.col(session_col).alias("session_id"), F.posexplode(entries_col).alias("position", "e")).select(
        "session_id", "position", "e.placeholder", "e.original", type_of_placeholder(F.col("e.placeholder")).alias("entity_type")
    )


def session_mappings(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """(session_id, mapping) of the sessions that have entries; equal placeholders: the last position wins.

    Equal placeholders are reduced before a session's entries are gathered, so a session of
    many turns gathers no more than its distinct placeholders.
    """
    last = mappings.groupBy("session_id", "placeholder").agg(F.max_by("original", "position").alias("original"), F.min("position").alias("first"))
    grouped = last.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("first", "placeholder", "original"))).alias("e"))
    entries = F.transform("e", lambda x: F.struct(x["placeholder"].alias("key"), x["original"].alias("value")))
    return sessions.select("session_id").join(grouped.select("session_id", F.map_from_entries(entries).alias("mapping")), "session_id")


def without_sessions(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows left after the deletion of sessions cascades (rows without a session stay)."""
    return rows.join(deleted.select("session_id").distinct(), "session_id", "left_anti").select(*rows.columns)


def orphan_sessions(sessions: DataFrame, mappings: DataFrame) -> DataFrame:
    """Sessions nothing refers to."""
    return sessions.join(mappings.select("session_id").distinct(), "session_id", "left_anti").select(*sessions.columns)


def expired(sessions: DataFrame, now: Column) -> DataFrame:
    """Active sessions past their expiry; without one they don't expire."""
    return sessions.where((F.col("expires_at") < now) & F.col("is_active"))


def deactivate_expired(sessions: DataFrame, now: Column) -> DataFrame:
    over = F.coalesce((F.col("expires_at") < now) & F.col("is_active"), F.lit(False))
    return sessions.withColumn("is_active", F.when(over, F.lit(False)).otherwise(F.col("is_active")))


def extend_expiry(sessions: DataFrame, seconds: int, wanted: Column) -> DataFrame:
    """Pushes back the expiry of the sessions ``wanted`` picks."""
    later = F.col("expires_at") + F.expr(f"interval {int(seconds)} seconds")
    return sessions.withColumn("expires_at", F.when(wanted, later).otherwise(F.col("expires_at")))


def alive(entries: DataFrame, stamp: str, ttl: str, now: Column) -> DataFrame:
    """Entries whose age is at most their time to live in seconds."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col(stamp).cast("timestamp"))
    return entries.where(age <= F.col(ttl) * 1_000_000)


def detections_of(anonymized: DataFrame, keys: list[str], spans_col: str) -> DataFrame:
    """(keys, entity_type, count): a row per distinct type of a row's spans, each with the row's total of spans."""
    types = F.array_distinct(F.transform(spans_col, lambda s: s["entity_type"]))
    return anonymized.select(*keys, F.size(spans_col).alias("count"), F.explode(types).alias("entity_type")).select(*keys, "entity_type", "count")


def retained(rows: DataFrame, stamp: str, days: int, now: Column) -> DataFrame:
    """Rows no older than the policy's retention."""
    return rows.where(F.col(stamp) >= now - F.expr(f"interval {int(days)} days"))


def storable(mappings: DataFrame, unstorable: frozenset[str]) -> DataFrame:
    """Mapping rows without the types a policy forbids to store."""
    return mappings.where(~F.col("entity_type").isin(sorted(unstorable))) if unstorable else mappings


def newest(rows: DataFrame, stamp: str, tie: str, n: int, skip: int = 0) -> DataFrame:
    """A page of the newest rows; ties by id, newest first."""
    page = rows.orderBy(F.desc(stamp), F.desc(tie))
    return (page.offset(skip) if skip else page).limit(n)


def first_in_first_out(hits: DataFrame, key: str, order: str, size: int) -> DataFrame:
    """Cache keys still held after all hits under FIFO eviction: the last ``size`` keys by their first arrival.

    Reads don't refresh. A global order needs one ranking task, so keys are reduced first and cut to ``size`` by a top-n sort.
    """
    return hits.groupBy(key).agg(F.min(order).alias("arrived")).orderBy(F.desc("arrived"), F.desc(key)).limit(size)
