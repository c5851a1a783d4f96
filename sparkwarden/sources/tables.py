"""Stored events and alerts, and their JSON form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import MapType

from ..functions.timestamps import iso_text
from ..schemas import ALERT_COLUMNS, EVENT_COLUMNS, EVENT_SCHEMA


def _with_columns(df: DataFrame) -> DataFrame:
    """All event columns, with the defaults of the event table."""
    missing = [f for f in EVENT_SCHEMA if f.name not in df.columns]
    df = df.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing})
    return df.withColumn("anomaly_score", F.coalesce("anomaly_score", F.lit(0.0)))


# Columns of point lookups, and the distinct values a row group's filter is made for.
LOOKED_UP = {"event_id": 1_000_000, "source_ip": 100_000}


def _bloom_filters() -> dict[str, str]:
    options = {}
    for column, values in LOOKED_UP.items():
        options[f"parquet.bloom.filter.enabled#{column}"] = "true"
        options[f"parquet.bloom.filter.expected.ndv#{column}"] = str(values)
    # A filter is cut to what a row group's values need.
    return {**options, "parquet.bloom.filter.adaptive.enabled": "true"}


def write_events(events: DataFrame, path: str) -> None:
    """Append events to Parquet by day.

    Rebalancing by day lets Spark split a busy day over several files and join quiet
    ones in a task. Rows are sorted by time in each file, for tight statistics on the
    time column; Bloom filters on the columns of ``LOOKED_UP`` let a lookup skip the row
    groups that do not hold its value. An event without a time would end up in no day, so
    ``validate_events`` first.
    """
    (
        _with_columns(events)
        .select(*EVENT_COLUMNS)
        .withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", "timestamp", "event_id")
        .write.mode("append")
        .options(**_bloom_filters())
        .partitionBy("event_date")
        .parquet(path)
    )


def stream_events(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of events; exactly once through the checkpoint."""
    return (
        _with_columns(events)
        .select(*EVENT_COLUMNS)
        .withColumn("event_date", F.to_date("timestamp"))
        .writeStream.format("parquet")
        .partitionBy("event_date")
        .option("checkpointLocation", checkpoint)
        .option("path", path)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Stored events; metadata kept as JSON text is decoded."""
    df = spark.read.parquet(path)
    if not isinstance(df.schema["metadata"].dataType, MapType):
        df = df.withColumn("metadata", F.from_json("metadata", "map<string,string>"))
    return df


def write_alerts(alerts: DataFrame, path: str) -> None:
    """Append alerts; new ones are open and dated by the event that raised them."""
    alerts.select(*ALERT_COLUMNS).write.mode("append").parquet(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


ALERT_BUCKETS = 32


def write_alert_table(df: DataFrame, name: str, path: str, buckets: int = ALERT_BUCKETS) -> None:
    """Append alerts, or acknowledgements of alerts, to a table bucketed and sorted by ``alert_id``.

    Two such tables with the same number of buckets are joined bucket by bucket:
    ``acknowledge`` over them moves no alert.
    """
    (
        df.repartition(buckets, "alert_id")
        .write.mode("append")
        .bucketBy(buckets, "alert_id")
        .sortBy("alert_id")
        .option("path", path)
        .saveAsTable(name)
    )


def to_wire_json(events: DataFrame) -> DataFrame:
    """One JSON text per event in column ``value``, nulls written out."""
    body = F.struct(
        iso_text(F.col("timestamp")).alias("timestamp"),
        "source",
        "event_type",
        "severity",
        "raw_message",
        "source_ip",
        "dest_ip",
        "dest_port",
        F.coalesce(
            "metadata", F.create_map().cast("map<string,string>")
        ).alias("metadata"),
    )
    return events.select(F.to_json(body, {"ignoreNullFields": "false"}).alias("value"))
