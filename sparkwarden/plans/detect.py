"""From log lines to stored events, and from events to alerts."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.alerts import LOGIN_THRESHOLD, dns_alerts, login_alerts, traffic_alerts
from ..operators.dns import DnsForest, classify_dns, dns_queries
from ..operators.forest import IsolationForest
from ..operators.login import LOGIN_TYPES, score_logins
from ..operators.normalise import event_violations, parse_auth, parse_syslog, split_parsed
from ..operators.rules import BUILT_IN_RULES, Rule, matches_to_alerts, rule_matches
from ..operators.traffic import analyze_traffic
from ..schemas import EVENT_COLUMNS
from ..session import query_id
from ..sources.logs import route_sources

PARSERS = {"auth": parse_auth, "syslog": parse_syslog}


Parser = Callable[[DataFrame, datetime, bool], DataFrame]


def checked_logs(
    lines: dict[str, DataFrame],
    reference_ts: datetime,
    rollover: bool = False,
    parsers: dict[str, Parser] | None = None,
) -> DataFrame:
    """The lines of several sources, each parsed by its own parser.

    ``parsers`` adds or replaces parsers by source: functions of (lines, reference
    time, rollover) that return what ``parse_auth`` does.

    ``reject_reason`` is null for an event; else no format matched, there is no such
    date, or it names the table constraints that do not hold.
    """
    known = {**PARSERS, **(parsers or {})}
    parsed = {s: known[s](df, reference_ts, rollover) for s, df in lines.items()}
    broken = F.nullif(F.array_join(event_violations(), ","), F.lit(""))
    return route_sources(parsed).withColumn("reject_reason", F.coalesce("reject_reason", broken))


def normalise_logs(
    lines: dict[str, DataFrame],
    reference_ts: datetime,
    rollover: bool = False,
    parsers: dict[str, Parser] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(valid events, rejects) of the lines of several sources.

    Using both results parses the lines twice; ``store_logs`` does it once.
    """
    return split_parsed(checked_logs(lines, reference_ts, rollover, parsers))


def store_logs(
    lines: dict[str, DataFrame],
    path: str,
    reference_ts: datetime,
    rollover: bool = False,
    parsers: dict[str, Parser] | None = None,
) -> None:
    """Parse once and append events and rejects to one table, apart by folder."""
    _store(checked_logs(lines, reference_ts, rollover, parsers), path, "append")


def _store(checked: DataFrame, path: str, mode: str) -> None:
    (
        checked.withColumn("outcome", F.when(F.col("reject_reason").isNull(), "event").otherwise("reject"))
        .withColumn("event_date", F.to_date("timestamp"))
        .hint("rebalance", "outcome", "event_date")
        .sortWithinPartitions("outcome", "event_date", "timestamp", "event_id")
        .write.mode(mode)
        .partitionBy("outcome", "event_date")
        .parquet(path)
    )


def store_log_streams(
    lines: dict[str, DataFrame],
    path: str,
    checkpoint: str,
    reference_ts: datetime,
    rollover: bool = False,
    parsers: dict[str, Parser] | None = None,
    once: bool = True,
) -> list[StreamingQuery]:
    """Continuous intake: the lines of each source (``stream_logs``) parsed, checked and stored as they arrive.

    One query per source. A micro-batch has a folder of its own, named by its number and
    by its query, whose id stays with the checkpoint: a repeated batch replaces what it
    had written, and an intake with another checkpoint into the same table replaces
    nothing. ``stored_logs`` reads the table of all sources.
    """

    def start(source: str, stream: DataFrame) -> StreamingQuery:
        def step(batch: DataFrame, batch_id: int) -> None:
            checked = checked_logs({source: batch}, reference_ts, rollover, parsers)
            run = query_id(batch.sparkSession, f"{checkpoint}/{source}")
            _store(checked, f"{path}/origin={source}/run={run}/batch={batch_id}", "overwrite")

        writer = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/{source}")
        return (writer.trigger(availableNow=True) if once else writer).start()

    return [start(source, stream) for source, stream in lines.items()]


def stored_logs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(events, rejects) of a table written by ``store_logs``; each reads its own folder."""
    table = spark.read.parquet(path)
    events = table.filter(F.col("outcome") == "event").select(*EVENT_COLUMNS, "event_date")
    rejects = table.filter(F.col("outcome") == "reject").select(
        "event_id", "source", "raw_message", "reject_reason"
    )
    return events, rejects


def score_events(events: DataFrame, login_model: IsolationForest | None) -> DataFrame:
    """Events with ``anomaly_score`` filled in for logins."""
    login = (F.col("source") == "auth") & F.col("event_type").isin(*LOGIN_TYPES)
    others = events.filter(~F.coalesce(login, F.lit(False))).select(*EVENT_COLUMNS)
    return score_logins(events, login_model).select(*EVENT_COLUMNS).unionByName(others)


def row_alerts(
    events: DataFrame,
    login_model: IsolationForest | None = None,
    dns_model: DnsForest | None = None,
    login_threshold: float = LOGIN_THRESHOLD,
) -> DataFrame:
    """Alerts that one event decides; works on a stream as well."""
    alerts = dns_alerts(classify_dns(dns_queries(events), dns_model))
    if login_model is not None:
        alerts = login_alerts(score_logins(events, login_model), login_threshold).unionByName(alerts)
    return alerts


def detect(
    events: DataFrame,
    rules: Sequence[Rule] = BUILT_IN_RULES,
    login_model: IsolationForest | None = None,
    dns_model: DnsForest | None = None,
    snapshots: DataFrame | None = None,
    baseline: DataFrame | None = None,
    traffic_model: IsolationForest | None = None,
    login_threshold: float = LOGIN_THRESHOLD,
) -> DataFrame:
    """All alerts of a batch of events.

    Every branch reads the event table with its own filter and columns; nothing is
    cached, since a pruned scan is cheaper than storing a large table again.
    """
    branches = [
        matches_to_alerts(rule_matches(events, rules)),
        row_alerts(events, login_model, dns_model, login_threshold),
    ]
    if snapshots is not None and baseline is not None:
        branches.append(traffic_alerts(analyze_traffic(snapshots, baseline, traffic_model)))
    return reduce(DataFrame.unionByName, branches)


def with_progress(df: DataFrame, name: str = "progress") -> tuple[DataFrame, Observation]:
    """The frame and a counter of the rows that pass, filled when a job has run."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("events_processed")), seen
