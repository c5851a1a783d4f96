"""Who talks to whom."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .topk import newest

LOCAL = "local"


def graph_edges(events: DataFrame, newest_n: int | None = None) -> DataFrame:
    """Directed edges (src, dst, count); a missing address is ``local``."""
    if newest_n:
        events = newest(
            events.select("timestamp", "event_id", "source_ip", "dest_ip"), newest_n
        )
    return (
        events.select(
            F.coalesce("source_ip", F.lit(LOCAL)).alias("src"),
            F.coalesce("dest_ip", F.lit(LOCAL)).alias("dst"),
        )
        .filter(F.col("src") != F.col("dst"))
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def graph_nodes(edges: DataFrame) -> DataFrame:
    """Nodes (id, group, event_count); the count is of outgoing events."""
    ends = edges.select(
        F.explode(
            F.array(
                F.struct(F.col("src").alias("id"), F.col("count").alias("out")),
                F.struct(F.col("dst").alias("id"), F.lit(0).cast("bigint").alias("out")),
            )
        ).alias("end")
    )
    internal = F.col("id").startswith("10.") | F.col("id").startswith("192.168.")
    return (
        ends.groupBy(F.col("end.id").alias("id"))
        .agg(F.sum("end.out").alias("event_count"))
        .select(
            "id", F.when(internal, "internal").otherwise("external").alias("group"), "event_count"
        )
    )
