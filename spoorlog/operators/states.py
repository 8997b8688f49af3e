"""Upserts, session status, and rows without a session."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spoorlog.functions.text import non_empty, stable_uuid

STATUSES = ("pending", "processing", "completed", "failed")


def upsert_by_key(
    base: DataFrame, updates: DataFrame, key: str = "email",
    values: tuple[str, ...] = ("name", "image"), version: str = "version",
) -> DataFrame:
    """Insert new keys; for known ones replace ``values``, keep id and creation.

    Of several updates to one key the one with the highest ``version`` wins, of
    equal versions the greatest values, field by field in their order.
    Empty texts are stored as NULL. New rows take ``created_at`` from their first
    update.
    """
    place = F.struct(version, *[non_empty(F.col(v)).alias(v) for v in values])
    named = [F.max_by(non_empty(F.col(v)), place).alias(f"new_{v}") for v in values]
    latest = updates.groupBy(key).agg(
        *named, F.min_by("created_at", version).alias("new_created_at"), F.lit(True).alias("hit")
    )
    merged = base.join(latest, key, "full_outer")
    changed = {
        v: F.when(F.col("hit"), F.col(f"new_{v}")).otherwise(F.col(v)) for v in values
    }
    return merged.select(
        F.coalesce(F.col("id"), stable_uuid(F.col(key))).alias("id"),
        key,
        *[c.alias(v) for v, c in changed.items()],
        F.coalesce("created_at", "new_created_at").alias("created_at"),
    )


def latest_session_state(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Sessions after their status updates.

    ``updates`` has ``id``, ``status``, ``updated_at`` and ``log_count``, which may
    be NULL to leave the count as it is. Of updates at one time the one furthest
    on wins (pending, processing, completed, failed), then the greatest count.
    """
    counted = F.when(F.col("log_count").isNotNull(), F.struct("updated_at", "log_count"))
    reached = F.array_position(F.array(*map(F.lit, STATUSES)), F.col("status"))
    latest = updates.groupBy("id").agg(
        F.max_by("status", F.struct(F.col("updated_at"), reached.alias("reached"), F.col("status"))).alias("new_status"),
        F.max_by("log_count", counted).alias("new_count"),
        F.max("updated_at").alias("new_time"),
    )
    return (
        sessions.join(latest, "id", "left")
        .withColumns(
            {
                "status": F.coalesce("new_status", "status", F.lit("pending")),
                "log_count": F.coalesce("new_count", "log_count", F.lit(0)),
                "updated_at": F.coalesce("new_time", "updated_at"),
            }
        )
        .drop("new_status", "new_count", "new_time")
    )


def unknown_updates(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Updates to a session that does not exist, which are errors."""
    return updates.join(sessions.select("id"), "id", "left_anti")


def keep_valid_sessions(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    """Rows whose session exists; the rest go with their session."""
    return rows.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_semi")


def orphans(rows: DataFrame, sessions: DataFrame) -> DataFrame:
    return rows.join(sessions.select(F.col("id").alias("session_id")), "session_id", "left_anti")
