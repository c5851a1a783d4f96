"""Schemas shared by all jobs."""

from __future__ import annotations

from pyspark.sql import types as T

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("dest_ip", T.StringType()),
        T.StructField("dest_port", T.IntegerType()),
        T.StructField("raw_message", T.StringType()),
        T.StructField("anomaly_score", T.DoubleType()),
        T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
    ]
)

ALERT_SCHEMA = T.StructType(
    [
        T.StructField("alert_id", T.LongType()),
        T.StructField("event_cluster", T.ArrayType(T.StringType())),
        T.StructField("severity", T.StringType()),
        T.StructField("narrative", T.StringType()),
        T.StructField("acknowledged", T.IntegerType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)

EVENT_COLUMNS = EVENT_SCHEMA.fieldNames()
ALERT_COLUMNS = ALERT_SCHEMA.fieldNames()

# Fixed values of the event model, in natural order.
SOURCES = ("auth", "syslog", "network", "dns")
SEVERITIES = ("info", "low", "medium", "high", "critical")
