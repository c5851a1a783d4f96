"""Login behaviour: features, training and scoring."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import instant
from .forest import IsolationForest, fit_isolation_forest, score_isolation_forest
from .normalise import metadata_get

LOGIN_TYPES = ("ssh_failed", "ssh_success", "ssh_invalid_user")
LOGIN_FEATURES = (
    "hour_of_day",
    "day_of_week",
    "is_weekend",
    "source_ip_hash",
    "auth_success",
    "username_hash",
)
MIN_LOGINS = 10


def hash_bucket(text: Column, buckets: int = 1000) -> Column:
    """A number below ``buckets`` that is the same in every run and engine."""
    return (F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def login_events(events: DataFrame) -> DataFrame:
    return events.filter((F.col("source") == "auth") & F.col("event_type").isin(*LOGIN_TYPES))


def login_features(events: DataFrame) -> DataFrame:
    """Login events with the six features; Monday is day 0."""

    def known(column: Column) -> Column:
        return F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown"))

    weekday = F.weekday("timestamp")
    return login_events(events).withColumns(
        {
            "hour_of_day": F.hour("timestamp"),
            "day_of_week": weekday,
            "is_weekend": (weekday >= 5).cast("int"),
            "source_ip_hash": hash_bucket(known(F.col("source_ip"))),
            "auth_success": (F.col("event_type") == "ssh_success").cast("int"),
            "username_hash": hash_bucket(known(metadata_get("username", None))),
        }
    )


def fit_login_model(
    events: DataFrame, as_of: datetime, baseline_days: int = 30
) -> IsolationForest | None:
    """Forest on the logins of the ``baseline_days`` before ``as_of``."""
    until = instant(as_of)
    since = until - F.expr(f"INTERVAL {int(baseline_days)} DAYS")
    baseline = events.filter((F.col("timestamp") >= since) & (F.col("timestamp") < until))
    return fit_isolation_forest(
        login_features(baseline), LOGIN_FEATURES, "event_id", MIN_LOGINS
    )


def score_logins(events: DataFrame, model: IsolationForest | None) -> DataFrame:
    """Login events with features and ``anomaly_score``."""
    return score_isolation_forest(login_features(events), model)
