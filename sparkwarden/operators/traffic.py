"""Network traffic: snapshots, baseline, outliers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timestamps import instant
from .forest import IsolationForest, fit_isolation_forest, score_isolation_forest
from .normalise import metadata_get

# Fixed feature names, in order of the flags.
TRAFFIC_FEATURES = (
    "packets_per_second",
    "bytes_per_second",
    "unique_dest_ips",
    "unique_dest_ports",
    "tcp_ratio",
    "udp_ratio",
)
MIN_SNAPSHOTS = 30
Z_LIMIT = 3.0


def traffic_snapshots(events: DataFrame, width_seconds: int = 3600, by: Column | None = None) -> DataFrame:
    """One row per time window (and host): rates, distinct targets, protocol shares.

    Exact on a table and on a watermarked stream, in two steps that both can do: events
    become one row per window and target (an address or a port), partly aggregated before
    the shuffle, and the targets are counted and summed by window. So a busy window is
    not collected in one task, and no sketch is needed.
    """
    keys = ["window_start"] + (["host"] if by is not None else [])
    width = f"{int(width_seconds)} seconds"
    protocol = metadata_get("protocol", None)

    def target(kind: str) -> Column:
        once = F.lit(int(kind == "dest_ip"))
        return F.struct(F.lit(kind).alias("kind"), F.col(kind).cast("string").alias("value"), once.alias("once"))

    # The time takes part in the test: a stream's watermark then sees all events.
    network = events.filter(F.when(F.col("timestamp").isNotNull(), F.col("source") == "network")).select(
        F.window("timestamp", width).alias("w"),
        *([by.alias("host")] if by is not None else []),
        F.inline(F.array(target("dest_ip"), target("dest_port"))),
        F.coalesce(metadata_get("bytes", None).try_cast("double"), F.lit(0.0)).alias("bytes"),
        F.coalesce(protocol == "tcp", F.lit(False)).cast("int").alias("tcp"),
        F.coalesce(protocol == "udp", F.lit(False)).cast("int").alias("udp"),
    )
    groups = ["w"] + (["host"] if by is not None else [])
    # Each event counts through its address only; its port is there to be told apart.
    targets = network.groupBy(*groups, "kind", "value").agg(
        F.sum("once").alias("packets"),
        F.sum(F.col("once") * F.col("bytes")).alias("bytes"),
        F.sum(F.col("once") * F.col("tcp")).alias("tcp"),
        F.sum(F.col("once") * F.col("udp")).alias("udp"),
    )
    known = F.col("value").isNotNull()
    totals = targets.groupBy(*groups).agg(
        F.sum("packets").alias("packets"),
        F.sum("bytes").alias("bytes"),
        F.sum("tcp").alias("tcp"),
        F.sum("udp").alias("udp"),
        F.count_if((F.col("kind") == "dest_ip") & known).alias("unique_dest_ips"),
        F.count_if((F.col("kind") == "dest_port") & known).alias("unique_dest_ports"),
    )
    seconds = float(width_seconds)
    return totals.withColumn("window_start", F.col("w.start")).select(
        *keys,
        (F.col("packets") / seconds).alias("packets_per_second"),
        (F.col("bytes") / seconds).alias("bytes_per_second"),
        "unique_dest_ips",
        "unique_dest_ports",
        (F.col("tcp") / F.col("packets")).alias("tcp_ratio"),
        (F.col("udp") / F.col("packets")).alias("udp_ratio"),
    )


def recent_baseline(snapshots: DataFrame, as_of: datetime, days: int | None = None) -> DataFrame:
    """Snapshots before ``as_of``, of the last ``days`` if given."""
    until = instant(as_of)
    kept = snapshots.filter(F.col("window_start") < until)
    if days is not None:
        kept = kept.filter(F.col("window_start") >= until - F.expr(f"INTERVAL {int(days)} DAYS"))
    return kept


def baseline_stats(snapshots: DataFrame) -> DataFrame:
    """One row: sample count, and mean and deviation per feature.

    The deviation is the population one; a feature that never varies gets 1.
    """
    parts = [F.count(F.lit(1)).alias("samples")]
    for f in TRAFFIC_FEATURES:
        std = F.stddev_pop(f)
        # Rounding noise in the variance of a constant is not a deviation.
        constant = F.min(f) == F.max(f)
        parts += [
            F.avg(f).alias(f"{f}_mean"),
            F.when(constant | (std == 0), 1.0).otherwise(std).alias(f"{f}_std"),
        ]
    return snapshots.agg(*parts)


def _zscore(feature: str) -> Column:
    return F.abs((F.col(feature) - F.col(f"{feature}_mean")) / F.col(f"{feature}_std"))


def _only_row(df: DataFrame) -> DataFrame:
    """The one row of ``df``, as an aggregate: one row whatever ``df`` is, and an error when it has more."""
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *[F.first(c).alias(c) for c in df.columns])
    checked = F.when(F.col("_rows") > 1, F.raise_error(F.lit("a baseline is one row")).cast("bigint")).otherwise(F.col("samples"))
    return one.withColumn("samples", F.coalesce(checked, F.lit(0))).drop("_rows")


def zscore_flags(
    snapshots: DataFrame, baseline: DataFrame, limit: float = Z_LIMIT
) -> DataFrame:
    """Adds ``zscore_flags``, the features more than ``limit`` deviations off.

    No flag is raised from fewer than 30 samples. ``baseline`` is one row: more are an
    error, none is no sample.
    """
    flags = [
        F.when(
            (F.col("samples") >= MIN_SNAPSHOTS) & (_zscore(f) > limit),
            F.format_string(f"{f} (%.1fσ)", _zscore(f).cast("double")),
        )
        for f in TRAFFIC_FEATURES
    ]
    return (
        snapshots.crossJoin(F.broadcast(_only_row(baseline)))
        .withColumn("zscore_flags", F.array_compact(F.array(*flags)))
        .drop(*baseline.columns)
    )


def fit_traffic_model(snapshots: DataFrame) -> IsolationForest | None:
    host = [F.col("host")] if "host" in snapshots.columns else []
    row_id = F.concat_ws(":", F.unix_seconds("window_start").cast("string"), *host)
    return fit_isolation_forest(snapshots, TRAFFIC_FEATURES, row_id, MIN_SNAPSHOTS)


def analyze_traffic(
    snapshots: DataFrame,
    baseline: DataFrame,
    model: IsolationForest | None = None,
    limit: float = Z_LIMIT,
) -> DataFrame:
    """Adds flags, forest score, combined ``anomaly_score``, verdict and description."""
    flagged = zscore_flags(snapshots, baseline, limit)
    scored = score_isolation_forest(flagged, model, "forest_score")
    n_flags = F.size("zscore_flags")
    outliers = F.when(
        n_flags > 0,
        F.concat(F.lit("Statistical outliers: "), F.array_join("zscore_flags", ", ")),
    )
    multi = F.when(
        F.col("forest_score") > 0.5,
        F.format_string("Multi-feature anomaly score: %.2f", F.col("forest_score")),
    )
    text = F.nullif(F.concat_ws("; ", outliers, multi), F.lit(""))
    return scored.withColumn(
        "anomaly_score",
        F.greatest(F.col("forest_score"), F.least(F.lit(1.0), n_flags * F.lit(0.3))),
    ).withColumns(
        {
            "is_anomalous": (F.col("anomaly_score") > 0.5) | (n_flags >= 2),
            "description": F.coalesce(text, F.lit("Normal traffic pattern")),
        }
    )
