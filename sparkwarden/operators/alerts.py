"""Alerts: raising, listing, acknowledging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import instant, iso_text
from ..schemas import ALERT_COLUMNS
from .dns import NORMAL, TUNNELING
from .normalise import metadata_get
from .search import check_page, existing, has_id, total

LOGIN_THRESHOLD = 0.7
PREVIEW = 100

# Fixed texts and sentence formats.
NO_NARRATIVE = "No narrative available."
NO_PREVIEW = "No narrative"
LOGIN_SENTENCE = (
    "Anomalous login detected (score: %.2f). Source IP: %s, User: %s. "
    "This login deviates from established baseline patterns."
)
DNS_SENTENCE = (
    "Suspicious DNS query: %s classified as %s (confidence: %.0f%%). Subdomain entropy: %.2f."
)


def _alert(df: DataFrame, kind: str, severity: Column, narrative: Column, at: str, *id_parts: str):
    return df.select(
        F.xxhash64(F.lit(kind), at, *id_parts).alias("alert_id"),
        F.array(iso_text(F.col(at))).alias("event_cluster"),
        severity.alias("severity"),
        narrative.alias("narrative"),
        F.lit(0).alias("acknowledged"),
        F.col(at).alias("created_at"),
    ).select(*ALERT_COLUMNS)


def login_alerts(scored: DataFrame, threshold: float = LOGIN_THRESHOLD) -> DataFrame:
    """One alert per login scored at least ``threshold``."""
    text = F.format_string(
        LOGIN_SENTENCE,
        F.col("anomaly_score"),
        F.coalesce("source_ip", F.lit("None")),
        metadata_get("username"),
    )
    hits = scored.filter(F.col("anomaly_score") >= threshold)
    return _alert(hits, "login", F.lit("high"), text, "timestamp", "event_id")


def dns_alerts(classified: DataFrame) -> DataFrame:
    """One alert per DNS query not classified as normal."""
    text = F.format_string(
        DNS_SENTENCE,
        "domain",
        "label",
        F.col("confidence") * 100,
        F.coalesce(F.try_element_at("features", F.lit("entropy")), F.lit(0.0)),
    )
    hits = classified.filter(F.col("label") != NORMAL)
    severity = F.when(F.col("label") == TUNNELING, "high").otherwise("medium")
    return _alert(hits, "dns", severity, text, "timestamp", "event_id")


def traffic_alerts(analyzed: DataFrame) -> DataFrame:
    """One alert per anomalous traffic snapshot."""
    hits = analyzed.filter("is_anomalous")
    host = ["host"] if "host" in analyzed.columns else []
    text = F.format_string(
        "Anomalous network traffic (score: %.2f): %s", F.col("anomaly_score"), "description"
    )
    return _alert(hits, "traffic", F.lit("high"), text, "window_start", *host)


def list_alerts(
    alerts: DataFrame,
    acknowledged: bool | None = None,
    severity: str | None = None,
    limit: int = 50,
    offset: int = 0,
    after: tuple[datetime, int] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(page, total), newest first. ``after`` takes the (time, id) of the last row seen instead of an offset."""
    check_page(limit, offset, None)
    if acknowledged is not None:
        alerts = alerts.filter(F.col("acknowledged") == int(acknowledged))
    if severity:
        alerts = alerts.filter(F.col("severity") == severity)
    rest = alerts
    if after is not None:
        made, last = F.col("created_at"), instant(after[0])
        rest = alerts.filter((made < last) | ((made == last) & (F.col("alert_id") < after[1])))
    ordered = rest.orderBy(F.col("created_at").desc(), F.col("alert_id").desc())
    return (ordered.offset(offset) if offset else ordered).limit(limit), total(alerts)


def alert_narrative(alerts: DataFrame, alert_id: int | str | None = None) -> DataFrame:
    """Readable narrative of one alert, or of all; a stand-in when it is empty. An id that no alert has is an error."""
    if alert_id is not None:
        alerts = existing(alerts.filter(has_id("alert_id", alert_id)), f"alert {alert_id}")
    cluster = F.col("event_cluster")
    if alerts.schema["event_cluster"].dataType.simpleString() == "string":
        cluster = F.from_json(cluster, "array<string>")
    return alerts.select(
        "alert_id",
        "severity",
        F.coalesce(F.nullif("narrative", F.lit("")), F.lit(NO_NARRATIVE)).alias("narrative"),
        cluster.alias("event_cluster"),
    )


def acknowledge(alerts: DataFrame, acks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(alerts with their state, acknowledged ids that no alert has).

    ``acks`` is an append-only table with the column ``alert_id``; repeating an id
    changes nothing. Its size is left to the optimizer: acknowledgements grow with
    the alerts, so neither side is forced into a broadcast.
    """
    known = acks.select("alert_id").distinct()
    state = alerts.join(known.withColumn("_ack", F.lit(1)), "alert_id", "left").withColumn(
        "acknowledged",
        F.greatest(F.coalesce("acknowledged", F.lit(0)), F.coalesce("_ack", F.lit(0))),
    )
    return state.drop("_ack"), known.join(alerts, "alert_id", "left_anti")


def alert_preview(alerts: DataFrame, length: int = PREVIEW) -> DataFrame:
    """Adds ``preview``, the start of the narrative."""
    text = F.col("narrative")
    cut = F.concat(F.substring(text, 1, length), F.lit("..."))
    return alerts.withColumn(
        "preview",
        F.when(text.isNull(), NO_PREVIEW)
        .when(F.length(text) > length, cut)
        .otherwise(text),
    )
