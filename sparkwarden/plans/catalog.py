"""The registered queries: each reads the whole tables below ``sf_dir``."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.severity import severity_from_text, severity_rank
from ..functions.timestamps import instant, iso_text
from ..operators import alerts as al
from ..operators import dns, forest, graph, login, narratives, normalise, rollups, rules, search
from ..operators import sequences, stats, textindex, traffic
from ..schemas import EVENT_COLUMNS
from ..session import shared_dir
from ..sources import logs, tables
from ..streaming import jobs, sliding
from ..streaming.rule_batches import read_rule_stream, run_rule_stream
from ..streaming.rules import stream_rule_matches
from ..streaming.sequences import stream_followed_by
from . import detect as plan
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PAGE_COLUMNS = ("event_id", "timestamp", "source", "event_type", "severity", "source_ip")
BURST_RULES = {r.rule_id: r for r in rules.BUILT_IN_RULES}
BASELINE_END = datetime(2024, 1, 25)
SHOWN = ("severity", "narrative", "created_at")
# Few logins reach the usual threshold.
LOW_THRESHOLD = 0.52
EXFIL_HOST = "concat('host', cast(pmod(event_id, 3) as string))"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def plain_times(df: DataFrame) -> DataFrame:
    """Instants as wall-clock times, so that any client shows them alike."""
    return df.select(
        *[
            F.col(f.name).cast("timestamp_ntz").alias(f.name)
            if f.dataType.typeName() == "timestamp"
            else F.col(f.name)
            for f in df.schema
        ]
    )


def _page(df: DataFrame) -> DataFrame:
    return plain_times(df.select(*PAGE_COLUMNS))


def _pairs(column: str) -> F.Column:
    """A (value, count) list as text."""
    return F.array_join(
        F.transform(
            F.col(column), lambda p: F.concat(p["value"], F.lit("="), p["count"].cast("string"))
        ),
        ",",
    ).alias(column)


# Search --------------------------------------------------------------------------------


@query
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = search.search_events(
        fx.sec_events(spark, sf_dir), source="auth", severity="medium", limit=100, offset=50
    )
    return _page(page)


@query
def search_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(
        search.page_events(
            fx.sec_events(spark, sf_dir), "severity", "desc", 500, severity_order="rank"
        )
    )


@query
def search_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(
        search.page_events(
            fx.sec_events(spark, sf_dir),
            "source",
            "asc",
            limit=200,
            after=("dns", 300),
        )
    )


@query
def search_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, total = search.search_events(
        fx.sec_events(spark, sf_dir), event_type="ssh_failed", source_ip="10.0.0.7"
    )
    return total


@query
def search_time_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.event_filter(
        fx.sec_events(spark, sf_dir),
        start="2024-01-10T00:00:00",
        end="2024-01-17T12:00:00",
        source="network",
    )
    return _page(found)


@query
def event_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(search.get_event(fx.sec_events(spark, sf_dir), 17))


@query
def text_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = search.TextQuery(all_of=["the", "and"], none_of=["of"])
    return search.text_search(docs, wanted, "text").select("doc_id", "lang")


@query
def text_search_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    wanted = search.TextQuery(any_of=["Réau", "thntion", "eauen"])
    return search.text_search(docs, wanted, "text").select("doc_id", "lang")


@query
def text_search_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = search.TextQuery(phrase="failed password for invalid user", all_of=["host1"])
    found = search.text_search(fx.sec_events(spark, sf_dir), wanted)
    return _page(found)


@query
def text_search_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return search.text_search(docs, search.TextQuery(prefix="ouè"), "text").select("doc_id", "lang")


@query
def text_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search answered through a stored word index of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = shared_dir(spark, "words")
    search.write_word_index(docs, index, "doc_id", "text")
    wanted = search.TextQuery(all_of=["the", "and"], none_of=["of"])
    return search.index_search(spark, index, docs, wanted, "doc_id", "text").select(
        "doc_id", "lang"
    )


@query
def text_index_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A phrase, a word and an exclusion from a stored positional index of all log lines."""
    index = shared_dir(spark, "lines")
    textindex.write_text_index(fx.sec_events(spark, sf_dir), index)
    wanted = search.TextQuery(phrase="failed password for invalid user", all_of=["host1"], none_of=["user3"])
    return _page(textindex.text_index_search(spark, index, wanted))


@query
def word_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per word of the word index of all log lines."""
    postings = search.word_postings(fx.sec_events(spark, sf_dir))
    return postings.groupBy("word").agg(F.count(F.lit(1)).alias("rows"))


# Dashboard -----------------------------------------------------------------------------


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = al.acknowledge(fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir))
    return stats.overview(fx.sec_events(spark, sf_dir), state, datetime(2024, 1, 29, 12))


@query
def overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _overview(spark, sf_dir).select(
        "total_events",
        "events_last_hour",
        "open_alerts",
        _pairs("severity_breakdown"),
        _pairs("top_source_ips"),
        _pairs("top_event_types"),
    )


@query
def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.cards(_overview(spark, sf_dir))


@query
def severity_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stats.severity_breakdown(fx.sec_events(spark, sf_dir))
    return rows.withColumn("severity_rank", severity_rank(F.col("severity")))


@query
def top_source_ips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_source_ips(fx.sec_events(spark, sf_dir))


@query
def top_event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.top_event_types(fx.sec_events(spark, sf_dir))


@query
def top_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = stats.source_shares(stats.top_source_ips(fx.sec_events(spark, sf_dir)))
    return shares.withColumn("share", F.round("share", 9))


@query
def heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.heatmap(fx.sec_events(spark, sf_dir), fx.AS_OF)


@query
def heatmap_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    sparse = stats.heatmap(
        fx.sec_events(spark, sf_dir).filter("severity in ('high', 'critical')"), fx.AS_OF
    )
    return stats.dense_heatmap(spark, sparse)


@query
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timeline_labels(stats.timeline(fx.sec_events(spark, sf_dir)))


@query
def timeline_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = stats.timeline(fx.sec_events(spark, sf_dir), newest_n=500, include_low=True)
    return stats.timeline_labels(buckets)


@query
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_edges(fx.sec_events(spark, sf_dir))


@query
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.graph_nodes(graph.graph_edges(fx.sec_events(spark, sf_dir)))


@query
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(stats.recent(fx.sec_events(spark, sf_dir)))


@query
def recent_by_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(stats.recent_by_severity(fx.sec_events(spark, sf_dir), "high", within=5000))


@query
def live_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(stats.live_feed(fx.sec_events(spark, sf_dir)))


@query
def wire_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read back from the JSON form of every event, and where it says null."""
    value = F.col("value")
    fields = ["timestamp", "source", "event_type", "severity", "source_ip", "raw_message", "dest_ip", "dest_port"]
    entries = ["username", "protocol", "bytes", "domain"]
    return tables.to_wire_json(fx.sec_events(spark, sf_dir)).select(
        *[F.get_json_object(value, f"$.{f}").alias(f) for f in fields],
        *[F.get_json_object(value, f"$.metadata.{f}").alias(f) for f in entries],
        value.contains('"source_ip":null').alias("no_source"),
        value.contains('"dest_port":null').alias("no_port"),
    )


def _rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all events as a stream keeps them."""
    work = shared_dir(spark, "rollup")
    rollups.run_rollup_stream(fx.stream_events(spark, sf_dir), f"{work}/counts", f"{work}/checkpoint").awaitTermination()
    return rollups.read_rollup(spark, f"{work}/counts")


@query
def rollup_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``overview`` from stored counts, as of a time inside an hour."""
    state, _ = al.acknowledge(fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir))
    row = rollups.overview(_rollup(spark, sf_dir), fx.sec_events(spark, sf_dir), state, datetime(2024, 1, 29, 12, 20))
    lists = [_pairs(c) for c in ("severity_breakdown", "top_source_ips", "top_event_types")]
    return row.select("total_events", "events_last_hour", "critical_events", "open_alerts", *lists)


@query
def rollup_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.heatmap(_rollup(spark, sf_dir), fx.sec_events(spark, sf_dir), fx.AS_OF)


@query
def rollup_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.timeline_labels(rollups.timeline(_rollup(spark, sf_dir)))


# Log lines -----------------------------------------------------------------------------


@query
def parse_auth(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = normalise.split_parsed(
        normalise.parse_auth(fx.sec_lines(spark, sf_dir), fx.AS_OF)
    )
    return plain_times(
        events.select(
            "event_id",
            "timestamp",
            "event_type",
            "severity",
            "source_ip",
            normalise.metadata_get("username").alias("username"),
            normalise.metadata_get("port", "").alias("port"),
            normalise.metadata_get("command", "").alias("command"),
        )
    )


@query
def parse_syslog(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, _ = normalise.split_parsed(
        normalise.parse_syslog(fx.sec_lines(spark, sf_dir), fx.AS_OF)
    )
    return plain_times(
        events.select(
            "event_id",
            "timestamp",
            "event_type",
            "severity",
            normalise.metadata_get("hostname").alias("hostname"),
            normalise.metadata_get("process").alias("process"),
        )
    )


@query
def parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What neither parser takes, each line tried by the parser of its source."""
    lines = fx.sec_events(spark, sf_dir).select(
        "event_id", F.col("raw_message").alias("value"), "source"
    )
    by_source = {
        "auth": lines.filter("source = 'auth'").drop("source"),
        "syslog": lines.filter("source <> 'auth'").drop("source"),
    }
    _, rejected = plan.normalise_logs(by_source, fx.AS_OF)
    return rejected


def _log_files(spark: SparkSession, sf_dir: str) -> str:
    """All lines as log files, by source; returns their folder."""
    folder = shared_dir(spark, "logs")
    lines = fx.sec_events(spark, sf_dir).select("source", F.col("raw_message").alias("value"))
    for name, wanted in (("auth", "source = 'auth'"), ("syslog", "source <> 'auth'")):
        lines.filter(wanted).select("value").write.text(f"{folder}/{name}")
    return folder


def _stored_kinds(spark: SparkSession, path: str) -> DataFrame:
    events, rejected = plan.stored_logs(spark, path)
    kinds = events.select("source", "event_type", "severity").unionByName(
        rejected.select(
            "source", F.col("reject_reason").alias("event_type"), F.lit("").alias("severity")
        )
    )
    return kinds.groupBy("source", "event_type", "severity").agg(
        F.count(F.lit(1)).alias("count")
    )


@query
def ingest_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines written as log files, read back, parsed, checked and counted."""
    folder = _log_files(spark, sf_dir)
    found = logs.read_existing(
        spark, {"auth": f"{folder}/auth", "syslog": f"{folder}/syslog"}
    )
    plan.store_logs(found, f"{folder}/table", fx.AS_OF)
    return _stored_kinds(spark, f"{folder}/table")


@query
def ingest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by the continuous intake, one file of a source to a micro-batch."""
    folder = _log_files(spark, sf_dir)
    streams = {
        name: logs.stream_logs(spark, f"{folder}/{name}", max_files_per_trigger=1)
        for name in ("auth", "syslog")
    }
    running = plan.store_log_streams(streams, f"{folder}/table", f"{folder}/checkpoint", fx.AS_OF)
    for intake in running:
        intake.awaitTermination()
    return _stored_kinds(spark, f"{folder}/table")


@query
def syslog_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        fx.sec_events(spark, sf_dir)
        .groupBy("source", severity_from_text(F.col("raw_message")).alias("found"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


@query
def validate_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, invalid = normalise.validate_events(fx.sec_invalid(spark, sf_dir))
    return invalid.select("event_id", F.array_join("violations", ",").alias("violations"))


# Rules ---------------------------------------------------------------------------------


def _fires(spark: SparkSession, sf_dir: str, rule_id: str) -> DataFrame:
    rule = BURST_RULES[rule_id]
    matches = rules.rule_matches(fx.sec_burst(spark, sf_dir), [rule])
    return plain_times(
        matches.select(
            "rule_id",
            "group_key",
            "fired_at",
            "fired_id",
            "matched",
            F.array_join(F.transform("evidence", iso_text), ",").alias("evidence"),
        )
    )


@query
def fire_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir, "BRUTE_001")


@query
def fire_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir, "SCAN_001")


@query
def fire_exfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fires(spark, sf_dir, "EXFIL_001")


@query
def fire_borderline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window so short that the threshold is met only now and then."""
    fires = rules.fire_and_reset(
        fx.sec_burst(spark, sf_dir).filter("event_type = 'ssh_failed'"),
        F.col("source_ip"),
        window_seconds=2,
        threshold=4,
    )
    return plain_times(fires.select("group_key", "fired_at", "fired_id"))


@query
def priv_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = rules.rule_matches(fx.sec_events(spark, sf_dir), [BURST_RULES["PRIV_001"]])
    return plain_times(matches.select("group_key", "fired_at", "fired_id", "severity"))


@query
def match_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        rules.match_rules(fx.sec_events(spark, sf_dir))
        .groupBy("rule_id", "group_key")
        .agg(F.count(F.lit(1)).alias("count"))
    )


@query
def rule_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = rules.rule_matches(fx.sec_burst(spark, sf_dir))
    return plain_times(
        rules.matches_to_alerts(matches).select(
            F.to_json("event_cluster").alias("event_cluster"),
            "severity",
            "narrative",
            "acknowledged",
            "created_at",
        )
    )


@query
def recent_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = rules.recent_matches(rules.rule_matches(fx.sec_burst(spark, sf_dir)))
    return plain_times(matches.select("rule_id", "group_key", "fired_at", "fired_id"))


@query
def rolling_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = sequences.rolling_count(fx.sec_burst(spark, sf_dir), F.col("source_ip"), 5, columns=["event_id"])
    return counted.select("event_id", "rolling")


@query
def sudo_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sudo commands of a user shortly after a failed login of the user."""
    found = sequences.followed_by(
        fx.sec_burst(spark, sf_dir),
        F.col("event_type") == "ssh_failed",
        F.col("event_type") == "sudo_command",
        normalise.metadata_get("username"),
        within_seconds=3,
        columns=["event_id", "timestamp"],
    )
    return plain_times(found.select("event_id", "timestamp", "first_at"))


def _sudo_lines(events: DataFrame) -> DataFrame:
    """Events of the log lines, failed sudo passwords included."""
    parsed = normalise.parse_auth(fx.sudo_lines(events), fx.AS_OF, sudo_failures=True)
    return parsed.filter(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS)


SUDO_FAILED = "event_type = 'sudo_failed'"
SUDO_COMMAND = "event_type = 'sudo_command'"


@query
def sudo_failure_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sudo commands of a user within three minutes after a failed sudo password of the user."""
    found = sequences.followed_by(
        _sudo_lines(fx.sec_events(spark, sf_dir)),
        F.expr(SUDO_FAILED),
        F.expr(SUDO_COMMAND),
        normalise.metadata_get("username"),
        columns=["event_id", "timestamp"],
    )
    return plain_times(found.select("event_id", "timestamp", "first_at"))


@query
def port_scan_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sequences.distinct_in_window(
        fx.sec_burst(spark, sf_dir).filter("source = 'network'"),
        F.col("source_ip"),
        F.col("dest_port"),
        window_seconds=60,
        threshold=25,
    )
    return plain_times(found)


@query
def exfil_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    network = fx.sec_events(spark, sf_dir).filter("source = 'network'")
    found = sequences.deviation_from_baseline(
        network,
        F.expr(EXFIL_HOST),
        normalise.metadata_get("bytes", None).cast("double"),
        n_std=2.0,
    )
    return plain_times(
        found.select(
            "host",
            "bucket",
            F.round("total", 3).alias("total"),
            "samples",
            F.round("mean", 3).alias("mean"),
            F.round("std", 3).alias("std"),
        )
    )


# Features and models -------------------------------------------------------------------


@query
def login_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return login.login_features(fx.sec_events(spark, sf_dir)).select(
        "event_id", *login.LOGIN_FEATURES
    )


def _domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(
        F.regexp_extract("url", "://([^/?#:]+)", 1).alias("domain")
    )
    queried = dns.dns_queries(fx.sec_events(spark, sf_dir)).select("domain")
    return queried.unionByName(pages).distinct()


@query
def dns_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    featured = dns.dns_features(_domains(spark, sf_dir))
    return featured.select("domain", *[F.round(f, 9).alias(f) for f in dns.FEATURES])


@query
def dns_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    analysed = dns.dns_analysis(_domains(spark, sf_dir))
    return analysed.withColumn("subdomain_entropy", F.round("subdomain_entropy", 9))


@query
def dns_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = dns.classify_dns(_domains(spark, sf_dir))
    return labelled.select("domain", "label", "confidence")


@query
def dns_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    classified = dns.classify_dns(dns.dns_queries(fx.sec_events(spark, sf_dir)))
    raised = al.dns_alerts(classified)
    return plain_times(raised.select(*SHOWN))


@query
def dns_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every domain by a forest fitted to the heuristic's labels of three quarters of them."""
    domains = _domains(spark, sf_dir)
    model = _dns_forest(domains)
    found = dns.classify_dns(domains, model).withColumn("held_out", _held_out())
    return found.select("domain", "held_out", "label", "confidence")


def _held_out() -> Column:
    """A quarter of the domains, by the first digit of their hash, is never learned from."""
    return F.substring(F.md5(F.col("domain").cast("binary")), 1, 1).isin("0", "1", "2", "3")


def _dns_forest(domains: DataFrame) -> dns.DnsForest | None:
    return dns.fit_dns_forest(dns.classify_dns(domains.filter(~_held_out())).select("domain", "label"))


@query
def dns_forest_held_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per heuristic label, what the forest makes of domains it has not seen."""
    domains = _domains(spark, sf_dir)
    unseen = domains.filter(_held_out())
    model = _dns_forest(domains)
    found = dns.classify_dns(unseen, model).select("domain", F.col("label").alias("found"), "confidence", "features")
    met = dns.classify_dns(unseen).select("domain", "label", F.col("features").alias("wanted")).join(found, "domain")
    same = [F.col("features")[f].eqNullSafe(F.col("wanted")[f]) for f in dns.FEATURES]
    return met.groupBy("label").agg(
        F.count(F.lit(1)).alias("domains"),
        (F.avg((F.col("found") == F.col("label")).cast("int")) >= 0.9).alias("learned"),
        F.bool_and((F.col("confidence") > 1 / 3 - 1e-9) & (F.col("confidence") <= 1)).alias("shares"),
        F.bool_and(reduce(Column.__and__, same)).alias("same_features"),
    )


def _snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traffic.traffic_snapshots(fx.sec_events(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query
def traffic_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    floats = ["packets_per_second", "bytes_per_second", "tcp_ratio", "udp_ratio"]
    return plain_times(_rounded(_snapshots(spark, sf_dir), *floats))


@query
def traffic_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    floats = ["packets_per_second", "bytes_per_second", "tcp_ratio", "udp_ratio"]
    rows = traffic.traffic_snapshots(
        fx.sec_events(spark, sf_dir), 6 * 3600, by=F.col("source_ip")
    )
    return plain_times(_rounded(rows, *floats))


@query
def traffic_zscores(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    baseline = traffic.baseline_stats(traffic.recent_baseline(snapshots, BASELINE_END))
    flagged = traffic.zscore_flags(snapshots, baseline, limit=2.0)
    return plain_times(
        flagged.select("window_start", F.array_join("zscore_flags", ",").alias("flags"))
    )


@query
def traffic_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    analysed = traffic.analyze_traffic(snapshots, traffic.baseline_stats(snapshots), limit=2.0)
    return plain_times(
        analysed.select(
            "window_start",
            F.round("anomaly_score", 6).alias("anomaly_score"),
            "is_anomalous",
            "description",
        )
    )


@query
def login_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logins after the baseline, scored by a forest fitted to it."""
    events = fx.sec_events(spark, sf_dir)
    model = login.fit_login_model(events, BASELINE_END)
    later = events.filter(F.col("timestamp") >= instant(BASELINE_END))
    scored = forest.predict_anomaly(login.score_logins(later, model))
    return scored.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomaly")


@query
def traffic_forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    model = traffic.fit_traffic_model(traffic.recent_baseline(snapshots, BASELINE_END))
    analysed = traffic.analyze_traffic(snapshots, traffic.baseline_stats(snapshots), model)
    return plain_times(
        analysed.select(
            "window_start", F.round("anomaly_score", 6).alias("anomaly_score"), "is_anomalous"
        )
    )


@query
def login_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of logins the forest finds unusual, at a low threshold."""
    events = fx.sec_events(spark, sf_dir)
    model = login.fit_login_model(events, BASELINE_END)
    return plain_times(
        al.login_alerts(login.score_logins(events, model), LOW_THRESHOLD).select(*SHOWN)
    )


@query
def traffic_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    snapshots = _snapshots(spark, sf_dir)
    analysed = traffic.analyze_traffic(snapshots, traffic.baseline_stats(snapshots), limit=1.5)
    return plain_times(al.traffic_alerts(analysed).select(*SHOWN))


# Alerts --------------------------------------------------------------------------------


@query
def alerts_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = al.acknowledge(fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir))
    page, _ = al.list_alerts(state, acknowledged=False, severity="high", limit=200, offset=20)
    return plain_times(page.select("alert_id", "severity", "acknowledged", "created_at"))


@query
def alerts_ack(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = al.acknowledge(fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir))
    return state.select("alert_id", "acknowledged")


@query
def alerts_ack_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of alerts from two tables bucketed by id."""
    path = shared_dir(spark, "alerts")
    names = [f"{kind}_{uuid.uuid4().hex}" for kind in ("alerts", "acks")]
    for name, rows in zip(names, (fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir)), strict=True):
        tables.write_alert_table(rows, name, f"{path}/{name}")
    state, _ = al.acknowledge(spark.table(names[0]), spark.table(names[1]))
    return state.select("alert_id", "acknowledged")


@query
def alerts_ack_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, unknown = al.acknowledge(fx.sec_alerts(spark, sf_dir), fx.sec_acks(spark, sf_dir))
    return unknown


@query
def alert_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = al.alert_preview(al.alert_narrative(fx.sec_alerts(spark, sf_dir)), 60)
    return read.select(
        "alert_id", "narrative", "preview", F.col("event_cluster")[0].alias("event_time")
    )


@query
def anomalies_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    page, _ = search.list_anomalies(fx.sec_scored(spark, sf_dir), 0.9, limit=300, offset=10)
    return page.select("event_id", "anomaly_score")


@query
def cluster_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_times(
        narratives.cluster_digest(fx.sec_events(spark, sf_dir), F.col("source"), 360, n=5)
    )


@query
def cluster_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = narratives.event_clusters(fx.sec_events(spark, sf_dir), F.col("source_ip"), 1440)
    told = narratives.narrate(clusters)
    return plain_times(told.drop("dest_port", "window_minutes"))


@query
def session_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each source that end after an hour without events."""
    told = narratives.narrate(narratives.session_clusters(fx.sec_events(spark, sf_dir), F.col("source_ip"), 60))
    return plain_times(told)


@query
def detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all detectors."""
    events = fx.sec_burst(spark, sf_dir)
    snapshots = _snapshots(spark, sf_dir)
    found = plan.detect(
        events,
        login_model=login.fit_login_model(events, fx.AS_OF),
        login_threshold=LOW_THRESHOLD,
        snapshots=snapshots,
        baseline=traffic.baseline_stats(snapshots),
    )
    return plain_times(found.select(*SHOWN))


@query
def score_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events with the login forest's score."""
    events = fx.sec_events(spark, sf_dir)
    scored = plan.score_events(events, login.fit_login_model(events, fx.AS_OF))
    return scored.select("event_id", F.round("anomaly_score", 6).alias("anomaly_score"))


# Streams -------------------------------------------------------------------------------


def _replayed(spark: SparkSession, sf_dir: str, burst: bool) -> tuple[DataFrame, str]:
    """The event table as a finite stream that ends with a late sentinel event."""
    work = shared_dir(spark, "replay")
    batch = fx.sec_burst(spark, sf_dir) if burst else fx.sec_events(spark, sf_dir)
    fx.time_sentinel(batch).write.parquet(f"{work}/sentinel")
    stored = fx.stream_events(spark, sf_dir, burst)
    sentinel = spark.readStream.schema(stored.schema).parquet(f"{work}/sentinel")
    return stored.unionByName(sentinel), work


def _run(df: DataFrame, work: str) -> DataFrame:
    jobs.append_stream(df, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(f"{work}/out")


@query
def stream_brute(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, work = _replayed(spark, sf_dir, burst=True)
    fires = _run(stream_rule_matches(events, [BURST_RULES["BRUTE_001"]]), work)
    return plain_times(fires.select("rule_id", "group_key", "fired_at", "fired_id", "matched"))


@query
def stream_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules in one query."""
    events, work = _replayed(spark, sf_dir, burst=True)
    fires = _run(stream_rule_matches(events), work)
    return plain_times(fires.select("rule_id", "group_key", "fired_at", "fired_id"))


@query
def stream_rule_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All built-in rules by the variant for hot keys."""
    events, work = _replayed(spark, sf_dir, burst=True)
    run_rule_stream(events, f"{work}/out", f"{work}/checkpoint").awaitTermination()
    fires = read_rule_stream(spark, f"{work}/out")
    return plain_times(fires.select("rule_id", "group_key", "fired_at", "fired_id"))


@query
def detect_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of all streaming detectors."""
    events, work = _replayed(spark, sf_dir, burst=False)
    baseline = traffic.baseline_stats(
        traffic.recent_baseline(_snapshots(spark, sf_dir), BASELINE_END)
    )
    for started in jobs.detect_stream(
        events,
        f"{work}/alerts",
        f"{work}/checkpoints",
        login_model=login.fit_login_model(fx.sec_events(spark, sf_dir), BASELINE_END),
        login_threshold=LOW_THRESHOLD,
        traffic_baseline=baseline,
    ):
        started.awaitTermination()
    return plain_times(jobs.read_stream_alerts(spark, f"{work}/alerts").select(*SHOWN))


@query
def stream_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest events as the live feed holds them after the stream."""
    work = shared_dir(spark, "feed")
    events = fx.stream_events(spark, sf_dir)
    jobs.stream_live_feed(events, f"{work}/feed", f"{work}/checkpoint").awaitTermination()
    return _page(jobs.read_live_feed(spark, f"{work}/feed"))


@query
def stream_traffic(spark: SparkSession, sf_dir: str) -> DataFrame:
    events, work = _replayed(spark, sf_dir, burst=False)
    closed = _run(jobs.stream_snapshots(events), work)
    floats = ["packets_per_second", "bytes_per_second", "tcp_ratio", "udp_ratio"]
    return plain_times(_rounded(closed, *floats))


@query
def stream_sudo_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sudo_failure_sequence`` as a join of two streams of log lines."""
    events, work = _replayed(spark, sf_dir, burst=False)
    found = stream_followed_by(
        _sudo_lines(events).unionByName(events.filter("source_ip = 'clock'").select(*EVENT_COLUMNS)),
        F.expr(SUDO_FAILED),
        F.expr(SUDO_COMMAND),
        normalise.metadata_get("username"),
        columns=["event_id", "timestamp"],
    )
    return plain_times(_run(found, work).select("event_id", "timestamp", "first_at"))


@query
def stream_session_narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``session_narratives`` on the stream."""
    events, work = _replayed(spark, sf_dir, burst=False)
    sessions = narratives.session_clusters(events.withWatermark("timestamp", "10 minutes"), F.col("source_ip"), 60)
    return plain_times(narratives.narrate(_run(sessions, work)))


@query
def stream_port_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``port_scan_distinct`` on the stream."""
    events, work = _replayed(spark, sf_dir, burst=True)
    sliding.run_distinct_stream(
        events.filter("source = 'network'"),
        f"{work}/out",
        f"{work}/checkpoint",
        F.col("source_ip"),
        F.col("dest_port"),
        threshold=25,
    ).awaitTermination()
    return plain_times(sliding.read_sliding_stream(spark, f"{work}/out", sliding.DISTINCT))


@query
def stream_exfil(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``exfil_deviation`` on the stream."""
    events, work = _replayed(spark, sf_dir, burst=False)
    sliding.run_deviation_stream(
        events.filter(F.when(F.col("timestamp").isNotNull(), F.col("source") == "network")),
        f"{work}/out",
        f"{work}/checkpoint",
        F.expr(EXFIL_HOST),
        normalise.metadata_get("bytes", None).cast("double"),
        n_std=2.0,
    ).awaitTermination()
    found = sliding.read_sliding_stream(spark, f"{work}/out", sliding.DEVIATION)
    return plain_times(found.select("host", "bucket", *[F.round(c, 3).alias(c) for c in ("total", "mean", "std")], "samples"))


@query
def stored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written by day, read back and counted per day and source."""
    path = shared_dir(spark, "events")
    tables.write_events(fx.sec_events(spark, sf_dir), path)
    stored = tables.read_events(spark, path)
    return (
        search.event_filter(stored, start="2024-01-05T00:00:00", end="2024-01-20T23:59:59")
        .groupBy("event_date", "source")
        .agg(F.count(F.lit(1)).alias("count"))
    )
