"""Dashboard numbers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timestamps import instant, iso_text, sunday_first_day
from .topk import newest

TOP = 10


def top_k(df: DataFrame, column: str, k: int = TOP, nulls: bool = False) -> DataFrame:
    """Most frequent values, ties in value order; rows without one count as a value with ``nulls``."""
    return (
        (df if nulls else df.filter(F.col(column).isNotNull()))
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), F.col(column))
        .limit(k)
    )


def severity_breakdown(events: DataFrame) -> DataFrame:
    return (
        events.groupBy("severity")
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.col("count").desc(), "severity")
    )


def top_source_ips(events: DataFrame, k: int = TOP) -> DataFrame:
    return top_k(events, "source_ip", k)


def top_event_types(events: DataFrame, k: int = TOP) -> DataFrame:
    """Events without a type are listed as one."""
    return top_k(events, "event_type", k, nulls=True)


def source_shares(top_sources: DataFrame) -> DataFrame:
    """Each source of a top list relative to its first one."""
    return top_sources.withColumn(
        "share", F.col("count") / F.greatest(F.max("count").over(Window.partitionBy()), F.lit(1))
    )


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.filter(F.col("acknowledged") == 0).agg(
        F.count(F.lit(1)).alias("open_alerts")
    )


def overview(events: DataFrame, alerts: DataFrame, as_of: datetime, k: int = TOP) -> DataFrame:
    """All dashboard numbers as one row.

    One scan feeds every card: grouping sets count severities, addresses, event
    types and the total side by side, with partial aggregation before the shuffle.
    The rankings of addresses and types are cut while partial, so no long list reaches
    one task. Severities are listed all, and critical events are counted by themselves.
    """
    facets = ("severity", "source_ip", "event_type")
    recent = F.count_if(F.col("timestamp") >= instant(as_of) - F.expr("INTERVAL 1 HOUR"))
    counted = (
        events.select("timestamp", *facets)
        .groupingSets([[F.col(f)] for f in facets] + [[]], *facets)
        .agg(
            F.grouping_id().alias("_set"),
            F.count(F.lit(1)).alias("count"),
            recent.alias("last_hour"),
            F.count_if(F.col("severity") == "critical").alias("critical"),
        )
    )
    # grouping_id has one bit per facet, first facet highest, set when grouped away.
    sets = {"severity": 0b011, "source_ip": 0b101, "event_type": 0b110, "all": 0b111}
    value = F.coalesce(*facets)
    # Each severity is a list of its own, so none is cut.
    of_list = F.when(F.col("_set") == sets["severity"], F.coalesce("value", F.lit("")))
    rank = F.row_number().over(
        Window.partitionBy("_set", of_list).orderBy(F.col("count").desc(), "value")
    )
    ranked = (
        counted.withColumn("value", value)
        .filter((F.col("_set") != sets["source_ip"]) | F.col("source_ip").isNotNull())
        .withColumn("_rank", rank)
        .filter(F.col("_rank") <= max(k, 2))
    )

    def top(name: str) -> Column:
        wanted = F.col("_set") == sets[name]
        if name != "severity":
            wanted = wanted & (F.col("_rank") <= k)
        rows = F.collect_list(F.when(wanted, F.struct((-F.col("count")).alias("_order"), "value", "count")))
        return F.transform(
            F.array_sort(rows),
            lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count")),
        )

    def single(condition: Column, column: str) -> Column:
        return F.coalesce(F.max(F.when(condition, F.col(column))), F.lit(0))

    is_all = F.col("_set") == sets["all"]
    row = ranked.agg(
        single(is_all, "count").alias("total_events"),
        single(is_all, "last_hour").alias("events_last_hour"),
        single(is_all, "critical").alias("critical_events"),
        top("severity").alias("severity_breakdown"),
        top("source_ip").alias("top_source_ips"),
        top("event_type").alias("top_event_types"),
    )
    # Both sides are one row.
    return row.crossJoin(F.broadcast(open_alerts(alerts)))


def cards(overview_row: DataFrame) -> DataFrame:
    """The four headline numbers."""
    return overview_row.select(
        "total_events", "events_last_hour", "open_alerts", "critical_events"
    )


def heatmap(events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """Events per (day of week, hour) since ``days`` before ``as_of``; Sunday = 0."""
    since = instant(as_of) - F.expr(f"INTERVAL {int(days)} DAYS")
    return (
        events.filter(F.col("timestamp") >= since)
        .groupBy(
            sunday_first_day(F.col("timestamp")).alias("day"),
            F.hour("timestamp").alias("hour"),
        )
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy("day", "hour")
    )


def dense_heatmap(spark: SparkSession, buckets: DataFrame) -> DataFrame:
    """The full 7 x 24 grid with an intensity band 0 (no event) to 4.

    Rows of ``buckets`` for one cell add up; those outside the grid do not count.
    """
    calendar = spark.range(7 * 24).select(
        F.expr("cast(id div 24 as int)").alias("day"),
        F.expr("cast(id % 24 as int)").alias("hour"),
    )
    # At most 168 rows on either side, whatever comes in.
    inside = buckets.filter(F.col("day").between(0, 6) & F.col("hour").between(0, 23))
    cells = inside.groupBy("day", "hour").agg(F.sum("count").alias("count"))
    grid = calendar.join(F.broadcast(cells), ["day", "hour"], "left").withColumn(
        "count", F.coalesce("count", F.lit(0))
    )
    intensity = F.col("count") / F.greatest(
        F.max("count").over(Window.partitionBy()), F.lit(1)
    )
    band = (
        F.when(F.col("count") == 0, 0)
        .when(intensity > 0.75, 4)
        .when(intensity > 0.5, 3)
        .when(intensity > 0.25, 2)
        .otherwise(1)
    )
    return grid.withColumn("band", band)


def timeline(
    events: DataFrame, newest_n: int | None = None, include_low: bool = False
) -> DataFrame:
    """Events per hour and severity, oldest hour first."""
    shown = ["info", *(["low"] if include_low else []), "medium", "high", "critical"]
    if newest_n:
        events = newest(events.select("timestamp", "event_id", "severity"), newest_n)
    return (
        events.groupBy(F.date_trunc("hour", "timestamp").alias("hour"))
        .agg(*[F.count_if(F.col("severity") == s).alias(s) for s in shown])
        .orderBy("hour")
    )


def timeline_labels(buckets: DataFrame) -> DataFrame:
    """Hours as the text a chart shows, for example 2024-01-02T03:00."""
    return buckets.withColumn("hour", F.substring(iso_text(F.col("hour")), 1, 16))


def recent(events: DataFrame, n: int = 100) -> DataFrame:
    """The ``n`` newest events, oldest of them first."""
    return newest(events, n).orderBy("timestamp", "event_id")


def recent_by_severity(
    events: DataFrame, severity: str, n: int = 100, within: int = 10_000
) -> DataFrame:
    """Newest ``n`` events of one severity among the newest ``within`` events."""
    return recent(newest(events, within).filter(F.col("severity") == severity), n)


def live_feed(events: DataFrame, n: int = 200) -> DataFrame:
    """The ``n`` newest events, newest first."""
    return newest(events, n)
