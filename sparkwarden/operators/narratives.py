"""Readable summaries of groups of events."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .slices import MICROS, home_slice

NO_EVENTS = "No events to analyze."

# What is found, what shows it, what to do next; by the type of a cluster's first event.
PARTS = {
    "ssh_failed": (
        "Password guessing over SSH",
        "{count} wrong passwords sent by {source_ip} to port {dest_port}, all in {window} minutes",
        "ask who owns the address, and rate-limit it until somebody answers",
    ),
    "ssh_brute_force": (
        "SSH brute-force attempt",
        "the server cut {source_ip} off {count} times for too many tries",
        "drop packets of {source_ip}, then reset the accounts it aimed at",
    ),
    "ssh_invalid_user": (
        "Search for account names",
        "{source_ip} asked {count} times for users this machine does not have",
        "shut the address out and compare its names with the real ones",
    ),
    "connection_attempt": (
        "Port scan",
        "{source_ip} knocked {count} times in {window} minutes",
        "list the ports that answered and close those nobody needs",
    ),
    "dns_query": (
        "Odd DNS names",
        "{count} queries of {source_ip}, rated {attack_type}",
        "decode a few of the names and isolate the machine if they carry data",
    ),
}
DEFAULT_PARTS = (
    "Unusual run of {event_type}",
    "{count} events, severity {severity}, from {source_ip} in {window} minutes; {attack_type}",
    "find out what the address is used for",
)


def _sentence(finding: str, evidence: str, action: str) -> str:
    return f"{finding}: {evidence}. Next step: {action}."


TEMPLATES = {event_type: _sentence(*parts) for event_type, parts in PARTS.items()}
DEFAULT_TEMPLATE = _sentence(*DEFAULT_PARTS)


def event_clusters(events: DataFrame, key: Column, window_minutes: int) -> DataFrame:
    """Events grouped by key and time window, with the facts of their first event.

    Count and first event are partial aggregates: a busy key costs no task more
    than its share of the input.
    """
    first = F.min_by(
        F.struct("event_type", "source_ip", "dest_port"), F.struct("timestamp", "event_id")
    )
    return (
        events.groupBy(
            key.alias("cluster_key"), F.window("timestamp", f"{int(window_minutes)} minutes").alias("w")
        )
        .agg(F.count(F.lit(1)).alias("count"), first.alias("first"))
        .select(
            "cluster_key",
            F.col("w.start").alias("window_start"),
            "count",
            "first.*",
            F.lit(window_minutes).alias("window_minutes"),
        )
    )


def session_clusters(events: DataFrame, key: Column, gap_minutes: int) -> DataFrame:
    """Events grouped by key into sessions, which end when ``gap_minutes`` pass without an event.

    The same columns as ``event_clusters``; ``window_minutes`` are those from the first to
    the last event, begun ones in full. Events without a time are in no session. On
    a table, events first become one row per key and gap-long cell, partly aggregated: those of
    a cell are in one session anyway, so a busy key meets in one task as cells, not as
    events. On a watermarked stream Spark keeps the open sessions as its state.
    """
    gap_us = gap_minutes * 60 * MICROS
    us = F.unix_micros("timestamp")
    facts = F.struct("event_type", "source_ip", "dest_port")
    place = F.struct(us.alias("us"), F.col("event_id").alias("id"))
    merged = [
        F.count(F.lit(1)).alias("count"),
        F.min(F.struct(place.alias("place"), facts.alias("facts"))).alias("first"),
        F.max(us).alias("last_us"),
    ]
    keyed = events.filter(F.col("timestamp").isNotNull()).withColumn("cluster_key", key)
    if events.isStreaming:
        window = F.session_window("timestamp", f"{int(gap_minutes)} minutes")
        sessions = keyed.groupBy("cluster_key", window.alias("w")).agg(*merged)
    else:
        cells = keyed.groupBy("cluster_key", home_slice("unix_micros(timestamp)", gap_us).alias("cell")).agg(*merged)
        in_order = Window.partitionBy("cluster_key").orderBy("cell")
        begins = F.coalesce(F.col("first.place.us") - F.lag("last_us").over(in_order) > gap_us, F.lit(True))
        numbered = cells.withColumn("begins", begins.cast("int")).withColumn(
            "session", F.sum("begins").over(in_order.rowsBetween(Window.unboundedPreceding, 0))
        )
        sessions = numbered.groupBy("cluster_key", "session").agg(
            F.sum("count").alias("count"), F.min("first").alias("first"), F.max("last_us").alias("last_us")
        )
    minutes = F.ceil((F.col("last_us") - F.col("first.place.us")) / (60 * MICROS)).cast("int")
    return sessions.select(
        "cluster_key",
        F.timestamp_micros("first.place.us").alias("window_start"),
        "count",
        "first.facts.*",
        F.greatest(minutes, F.lit(1)).alias("window_minutes"),
    )


def _fill(template: str, values: dict[str, Column]) -> Column:
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name:
            parts.append(values[name])
    return F.concat(*parts)


def narrate(clusters: DataFrame) -> DataFrame:
    """Adds ``narrative`` by the type of a cluster's first event.

    Needs ``count``, ``event_type``, ``source_ip`` and ``dest_port``; the context
    columns ``severity``, ``attack_type`` and ``window_minutes`` are optional.
    """

    def context(name: str, default: str) -> Column:
        if name not in clusters.columns:
            return F.lit(default)
        return F.coalesce(F.col(name).cast("string"), F.lit(default))

    values = {
        "count": F.col("count").cast("string"),
        "severity": context("severity", "medium"),
        "event_type": F.coalesce("event_type", F.lit("")),
        "source_ip": F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("unknown source")),
        "window": context("window_minutes", "unknown"),
        "attack_type": context("attack_type", "suspicious activity"),
        "dest_port": F.coalesce(
            F.nullif(F.col("dest_port"), F.lit(0)).cast("string"), F.lit("N/A")
        ),
    }
    text = F.when(F.col("count") == 0, NO_EVENTS)
    for event_type, template in TEMPLATES.items():
        text = text.when(F.col("event_type") == event_type, _fill(template, values))
    return clusters.withColumn("narrative", text.otherwise(_fill(DEFAULT_TEMPLATE, values)))


def cluster_digest(
    events: DataFrame, key: Column, window_minutes: int, n: int = 20, width: int = 120
) -> DataFrame:
    """The first ``n`` events of each cluster as text lines.

    Rows beyond the first n are dropped before the shuffle (the rank filter is
    also applied within each task), so a cluster of any size arrives small.
    """
    line = F.concat(
        F.lit("["),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"),
        F.lit("] "),
        F.upper("severity"),
        F.lit(" "),
        F.col("event_type"),
        F.lit(" from "),
        F.coalesce(F.nullif("source_ip", F.lit("")), F.lit("local")),
        F.lit(": "),
        F.substring("raw_message", 1, width),
    )
    keyed = events.select(
        key.alias("cluster_key"),
        F.window("timestamp", f"{int(window_minutes)} minutes")["start"].alias("window_start"),
        F.col("timestamp").alias("at"),
        F.col("event_id").alias("id"),
        line.alias("line"),
    )
    order = Window.partitionBy("cluster_key", "window_start").orderBy("at", "id")
    return (
        keyed.withColumn("_n", F.row_number().over(order))
        .filter(F.col("_n") <= n)
        .groupBy("cluster_key", "window_start")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("_n", "line"))), lambda x: x["line"]
                ),
                "\n",
            ).alias("digest")
        )
    )
