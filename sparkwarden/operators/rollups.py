"""Dashboards from stored counts: hours and facets instead of events.

A roll-up row is (hour, facet, value, count). Counts of the same hour, facet and value
simply add up, so tables of several batches are read as they are, late events included.
Where a bound lies inside an hour, the events of that one hour are read and rolled up on
the spot; all other hours come from the table.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.timestamps import instant, sunday_first_day
from ..session import query_id
from .search import event_filter
from .stats import TOP, open_alerts

FACETS = ("severity", "source_ip", "event_type")
ROLLUP = "hour timestamp, facet string, value string, count bigint"


def roll_up(events: DataFrame) -> DataFrame:
    """Events per hour and value of each facet; null values count as such, events without a time as of no hour."""
    facets = [F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in FACETS]
    rows = events.select(F.date_trunc("hour", "timestamp").alias("hour"), F.inline(F.array(*facets)))
    return rows.groupBy("hour", "facet", "value").agg(F.count(F.lit(1)).alias("count"))


def run_rollup_stream(events: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Keep roll-ups of a stream: each micro-batch adds a small table of counts.

    Folders are named by the query, whose id stays with the checkpoint, and the batch:
    repeating a failed batch replaces what it had written. No watermark: an event
    counts whenever it comes.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        run = query_id(batch.sparkSession, checkpoint)
        roll_up(batch).coalesce(1).write.mode("overwrite").parquet(f"{path}/run={run}/batch={batch_id}")

    writer = events.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The counts of all batches, added up; empty before the first one."""
    try:
        parts = spark.read.schema(f"{ROLLUP}, run string, batch bigint").parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ROLLUP)
    return parts.groupBy("hour", "facet", "value").agg(F.sum("count").alias("count"))


def since(rollup: DataFrame, events: DataFrame, cutoff: datetime) -> DataFrame:
    """Roll-up rows of what happened at ``cutoff`` or later; ``events`` are read for the hour it lies in only."""
    whole = cutoff.replace(minute=0, second=0, microsecond=0)
    if whole == cutoff:
        return rollup.filter(F.col("hour") >= instant(cutoff))
    edge = event_filter(events, start=cutoff, end=whole + timedelta(hours=1, microseconds=-1))
    return rollup.filter(F.col("hour") >= instant(whole + timedelta(hours=1))).unionByName(roll_up(edge))


def overview(rollup: DataFrame, events: DataFrame, alerts: DataFrame, as_of: datetime, k: int = TOP) -> DataFrame:
    """``stats.overview`` from stored counts."""
    recent = since(rollup, events, as_of - timedelta(hours=1)).filter("facet = 'severity'")
    last_hour = recent.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("events_last_hour"))
    totals = rollup.groupBy("facet", "value").agg(F.sum("count").alias("count"))
    shown = totals.filter((F.col("facet") != "source_ip") | F.col("value").isNotNull())
    # Severities are all listed and summed, a rank each; the other lists are cut before the shuffle.
    of_list = F.when(F.col("facet") == "severity", F.coalesce("value", F.lit("")))
    order = Window.partitionBy("facet", of_list).orderBy(F.col("count").desc(), "value")
    ranked = shown.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= k)

    def top(facet: str) -> F.Column:
        row = F.struct((-F.col("count")).alias("_order"), "value", "count")
        rows = F.array_sort(F.collect_list(F.when(F.col("facet") == facet, row)))
        return F.transform(rows, lambda r: F.struct(r["value"].alias("value"), r["count"].alias("count")))

    severity = F.col("facet") == "severity"
    row = ranked.agg(
        F.coalesce(F.sum(F.when(severity, F.col("count"))), F.lit(0)).alias("total_events"),
        F.coalesce(F.sum(F.when(severity & (F.col("value") == "critical"), F.col("count"))), F.lit(0)).alias("critical_events"),
        top("severity").alias("severity_breakdown"),
        top("source_ip").alias("top_source_ips"),
        top("event_type").alias("top_event_types"),
    )
    # All three sides are one row.
    joined = row.crossJoin(F.broadcast(last_hour)).crossJoin(F.broadcast(open_alerts(alerts)))
    return joined.select("total_events", "events_last_hour", "critical_events", *joined.columns[2:5], "open_alerts")


def heatmap(rollup: DataFrame, events: DataFrame, as_of: datetime, days: int = 7) -> DataFrame:
    """``stats.heatmap`` from stored counts."""
    counted = since(rollup, events, as_of - timedelta(days=days)).filter("facet = 'severity'")
    keys = [sunday_first_day(F.col("hour")).alias("day"), F.hour("hour").alias("hour_of_day")]
    cells = counted.groupBy(*keys).agg(F.sum("count").alias("count"))
    return cells.select("day", F.col("hour_of_day").alias("hour"), "count").orderBy("day", "hour")


def timeline(rollup: DataFrame, include_low: bool = False) -> DataFrame:
    """``stats.timeline`` of all events from stored counts."""
    shown = ["info", *(["low"] if include_low else []), "medium", "high", "critical"]
    counts = [F.coalesce(F.sum(F.when(F.col("value") == s, F.col("count"))), F.lit(0)).alias(s) for s in shown]
    return rollup.filter("facet = 'severity'").groupBy("hour").agg(*counts).orderBy("hour")
