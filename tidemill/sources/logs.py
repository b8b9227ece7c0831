"""Append-only logs and their newest-first listings."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemill.functions.types import ref
from tidemill.plans.session import materialize

LOG_SCHEMA = "id string, user_id string, action string, details string, page string, created_at timestamp"
FEEDBACK_SCHEMA = "id string, user_id string, rating int, comment string, page string, created_at timestamp"
LISTED, ACTIVITY_LISTED = 50, 200


def _now():
    return datetime.now(timezone.utc).replace(tzinfo=None)


def _append(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(path)


def log_action(spark: SparkSession, path: str, action: str, details: str = "", user_id: str = "", page: str = "") -> None:
    _append(spark, path, (uuid.uuid4().hex, user_id, action, details, page, _now()), LOG_SCHEMA)


def save_feedback(spark: SparkSession, path: str, rating: int, comment: str = "", user_id: str = "", page: str = "") -> None:
    _append(spark, path, (uuid.uuid4().hex, user_id, rating, comment, page, _now()), FEEDBACK_SCHEMA)


def append_rows(df: DataFrame, path: str) -> None:
    """Append a batch of log rows."""
    df.write.mode("append").parquet(path)


def newest(log: DataFrame, limit: int | None = LISTED, created: str = "created_at", tie: str = "id") -> DataFrame:
    """The newest entries first; all of them with ``limit=None``."""
    listed = log.orderBy(ref(created).desc(), ref(tie))
    return listed if limit is None else listed.limit(limit)


def activity(
    log: DataFrame,
    users: DataFrame,
    user_filter: str = "",
    action_filter: str = "",
    limit: int | None = ACTIVITY_LISTED,
) -> DataFrame:
    """The newest entries with the user's email, then filtered by text in email and action.

    The limit comes first, so a filter searches the newest entries only; without a limit it searches
    the whole log, and the two tables are joined as their sizes allow.
    """
    emails = users.select(F.col("id").alias("_user"), "email")
    if limit is None:
        latest = log
    else:
        latest = materialize(newest(log, limit))
        wanted = latest.select(F.col("user_id").alias("_user")).distinct()
        # both broadcasts hold at most `limit` rows; the user table is only filtered, never shuffled
        emails = F.broadcast(emails.join(F.broadcast(wanted), "_user"))
    found = latest.join(emails, F.col("user_id") == F.col("_user"), "left")
    if user_filter:
        found = found.where(F.coalesce(F.lower("email"), F.lit("")).contains(user_filter.lower()))
    if action_filter:
        found = found.where(F.coalesce(F.lower("action"), F.lit("")).contains(action_filter.lower()))
    return found.drop("_user").orderBy(F.desc("created_at"), "id")
