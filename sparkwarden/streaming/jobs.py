"""Continuous detection and feeds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import LOGIN_THRESHOLD, traffic_alerts
from ..operators.dns import DnsForest
from ..operators.forest import IsolationForest
from ..operators.rules import BUILT_IN_RULES, Rule, matches_to_alerts
from ..operators.topk import newest
from ..operators.traffic import analyze_traffic, traffic_snapshots
from ..plans.detect import row_alerts
from ..schemas import ALERT_SCHEMA, EVENT_COLUMNS, EVENT_SCHEMA
from .rule_batches import read_rule_stream, run_rule_stream


def append_stream(df: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet, exactly once through the checkpoint.

    ``once`` processes what has arrived and stops; otherwise the query runs on.
    """
    writer = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def drop_repeats(events: DataFrame, delivery_id: str, delay: str = "10 minutes") -> DataFrame:
    """Events delivered twice within the delay are kept once, by the id their sender gave the delivery.

    Event ids do not serve: equal lines have equal ids and are events of their own.
    """
    if delivery_id == "event_id":
        raise ValueError("event ids do not tell deliveries apart")
    return events.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark([delivery_id])


def stream_snapshots(
    events: DataFrame,
    width_seconds: int = 3600,
    by: Column | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """Traffic snapshots of closed windows, as exact as those of a table."""
    return traffic_snapshots(events.withWatermark("timestamp", delay), width_seconds, by)


def detect_stream(
    events: DataFrame,
    alerts_path: str,
    checkpoint: str,
    rules: Sequence[Rule] = BUILT_IN_RULES,
    login_model: IsolationForest | None = None,
    dns_model: DnsForest | None = None,
    traffic_baseline: DataFrame | None = None,
    traffic_model: IsolationForest | None = None,
    delay_seconds: int = 600,
    once: bool = True,
    login_threshold: float = LOGIN_THRESHOLD,
) -> list[StreamingQuery]:
    """Start the detection queries; each writes to its own folder of ``alerts_path``.

    Single-event alerts need no state; rules and traffic have their own queries, so
    a slow one does not hold up the others.
    """
    queries = [
        run_rule_stream(
            events, f"{alerts_path}/rules", f"{checkpoint}/rules", rules, delay_seconds, once
        )
    ]
    jobs = {"rows": row_alerts(events, login_model, dns_model, login_threshold)}
    if traffic_baseline is not None:
        closed = stream_snapshots(events, delay=f"{delay_seconds} seconds")
        jobs["traffic"] = traffic_alerts(
            analyze_traffic(closed, traffic_baseline, traffic_model)
        )
    for name, alerts in jobs.items():
        queries.append(
            append_stream(alerts, f"{alerts_path}/{name}", f"{checkpoint}/{name}", once)
        )
    return queries


def read_stream_alerts(
    spark: SparkSession, alerts_path: str, rules: Sequence[Rule] = BUILT_IN_RULES
) -> DataFrame:
    """Alerts of all detection queries; each folder is read through its commit log."""
    frames = [matches_to_alerts(read_rule_stream(spark, f"{alerts_path}/rules", rules))]
    for name in ("rows", "traffic"):
        try:
            frames.append(spark.read.schema(ALERT_SCHEMA).parquet(f"{alerts_path}/{name}"))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
    return reduce(DataFrame.unionByName, frames)


def stream_live_feed(
    events: DataFrame, path: str, checkpoint: str, n: int = 200, once: bool = True
) -> StreamingQuery:
    """Keep the ``n`` newest events, one small table per micro-batch.

    A batch merges the feed of the batch before with its own events. Repeating a
    failed batch overwrites its table with the same rows. A mark is written after the
    table: a feed counts once it is there.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        rows = batch.select(*EVENT_COLUMNS)
        if batch_id > 0:
            before = batch.sparkSession.read.schema(rows.schema).parquet(
                f"{path}/feed/batch={batch_id - 1}"
            )
            rows = rows.unionByName(before)
        newest(rows, n).write.mode("overwrite").parquet(f"{path}/feed/batch={batch_id}")
        batch.sparkSession.range(1).write.mode("overwrite").parquet(f"{path}/done/batch={batch_id}")

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_live_feed(spark: SparkSession, path: str) -> DataFrame:
    """The feed as of the last finished micro-batch; before the first one an empty feed."""
    try:
        last = spark.read.parquet(f"{path}/done").agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], EVENT_SCHEMA).select(*EVENT_COLUMNS)
    return spark.read.parquet(f"{path}/feed/batch={last}")


def events_processed(query: StreamingQuery) -> int:
    """Rows read by the batches the query remembers, once per read of a source."""
    return sum(p["numInputRows"] for p in query.recentProgress)


def late_rows(query: StreamingQuery) -> int:
    """Rows that stateful operators dropped for being later than the watermark."""
    return sum(
        op["numRowsDroppedByWatermark"]
        for p in query.recentProgress
        for op in p["stateOperators"]
    )
