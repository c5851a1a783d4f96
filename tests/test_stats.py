from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import graph, stats
from sparkwarden.operators.topk import newest

START = datetime(2026, 4, 9, 12)  # a Thursday


def ids(df):
    return [r.event_id for r in df.collect()]


def ticking(make_events, n, **more):
    return make_events([{"timestamp": START + timedelta(seconds=i), **more} for i in range(n)])


def test_overview_of_nothing(make_events, spark):
    alerts = spark.createDataFrame([], "alert_id bigint, acknowledged int")
    row = stats.overview(make_events([]), alerts, START).first()
    assert (row.total_events, row.events_last_hour, row.open_alerts) == (0, 0, 0)
    assert row.critical_events == 0 and row.top_source_ips == []


def test_overview(make_events, spark):
    rows = [
        {
            "timestamp": START - timedelta(minutes=20 * i),
            "source_ip": None if i % 4 == 0 else f"10.0.0.{i % 3}",
            "severity": "critical" if i < 2 else "info",
        }
        for i in range(12)
    ]
    alerts = spark.createDataFrame([(1, 0), (2, 1), (3, 0)], "alert_id bigint, acknowledged int")
    row = stats.overview(make_events(rows), alerts, START, k=2).first()
    assert (row.total_events, row.events_last_hour, row.open_alerts) == (12, 4, 2)
    assert [(r["value"], r["count"]) for r in row.severity_breakdown] == [
        ("info", 10), ("critical", 2),
    ]
    assert [(r["value"], r["count"]) for r in row.top_source_ips] == [
        ("10.0.0.0", 3), ("10.0.0.1", 3),
    ]
    assert row.critical_events == 2


def test_overview_reads_events_once(make_events, spark):
    alerts = spark.createDataFrame([], "alert_id bigint, acknowledged int")
    plan = stats.overview(make_events([{}]), alerts, START)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Expand") == 1 and "WindowGroupLimit" in text


def test_heatmap_days_start_on_sunday(make_events, spark):
    rows = [
        {"timestamp": datetime(2026, 4, 12, 3)},
        {"timestamp": datetime(2026, 4, 12, 3, 59)},
        {"timestamp": datetime(2026, 4, 11, 23)},
        {"timestamp": datetime(2026, 4, 1)},
    ]
    buckets = stats.heatmap(make_events(rows), datetime(2026, 4, 13))
    assert [tuple(r) for r in buckets.collect()] == [(0, 3, 2), (6, 23, 1)]
    grid = stats.dense_heatmap(spark, buckets).collect()
    assert len(grid) == 168
    assert {(r.day, r.hour): r.band for r in grid if r.band} == {(0, 3): 4, (6, 23): 2}
    # Whatever comes in, the grid has its cells once.
    odd = buckets.unionByName(buckets).unionByName(spark.createDataFrame([(9, 3, 50), (None, 1, 50)], buckets.schema))
    grid = stats.dense_heatmap(spark, odd).collect()
    assert len(grid) == 168 and {(r.day, r.hour): r["count"] for r in grid if r.band} == {(0, 3): 4, (6, 23): 2}


def test_timeline(make_events):
    rows = [{"severity": s} for s in ("info", "low", "high", "high")] + [
        {"severity": "low", "timestamp": START + timedelta(hours=1)}
    ]
    got = stats.timeline_labels(stats.timeline(make_events(rows))).collect()
    assert [tuple(r) for r in got] == [
        ("2026-04-09T12:00", 1, 0, 2, 0),
        ("2026-04-09T13:00", 0, 0, 0, 0),
    ]


def test_recent_is_oldest_first(make_events):
    events = ticking(make_events, 10)
    assert ids(stats.recent(events, 5)) == [5, 6, 7, 8, 9]
    assert ids(stats.live_feed(events, 3)) == [9, 8, 7]
    assert ids(stats.recent(events, 50)) == list(range(10))


def test_recent_by_severity_filters_inside_the_newest(make_events):
    rows = [
        {"timestamp": START + timedelta(seconds=i), "severity": "high" if i % 3 == 0 else "info"}
        for i in range(30)
    ]
    events = make_events(rows)
    assert ids(stats.recent_by_severity(events, "high", 2)) == [24, 27]
    assert ids(stats.recent_by_severity(events, "high", 100, within=5)) == [27]


@pytest.mark.parametrize("n", [1001, 1500, 5000])
def test_large_newest_cuts_by_hour(make_events, n):
    rows = [{"timestamp": START + timedelta(minutes=7 * (i % 400))} for i in range(2000)]
    want = sorted(range(2000), key=lambda i: (i % 400, i), reverse=True)[:n]
    assert ids(newest(make_events(rows), n)) == want


def test_graph(make_events):
    rows = (
        [{"source_ip": "10.0.0.1", "dest_ip": "8.8.8.8"}] * 3
        + [{"source_ip": None, "dest_ip": "10.0.0.1"}]
        + [{"source_ip": "1.1.1.1", "dest_ip": "1.1.1.1"}, {}]
    )
    edges = graph.graph_edges(make_events(rows))
    assert sorted(tuple(r) for r in edges.collect()) == [
        ("10.0.0.1", "8.8.8.8", 3),
        ("local", "10.0.0.1", 1),
    ]
    assert sorted(tuple(r) for r in graph.graph_nodes(edges).collect()) == [
        ("10.0.0.1", "internal", 3),
        ("8.8.8.8", "external", 0),
        ("local", "external", 1),
    ]


def test_shares(make_events):
    rows = [{"source_ip": "a"}] * 4 + [{"source_ip": "b"}]
    shares = stats.source_shares(stats.top_source_ips(make_events(rows)))
    assert {r.source_ip: r.share for r in shares.collect()} == {"a": 1.0, "b": 0.25}
    assert stats.cards(
        stats.overview(make_events(rows), make_events([]).select(
            F.col("event_id").alias("alert_id"), F.lit(0).alias("acknowledged")), START)
    ).first().total_events == 5


def test_overview_lists_every_severity(spark, make_events):
    events = make_events(
        [{"severity": f"odd{i}"} for i in range(15) for _ in range(2)]
        + [{"severity": "critical"}, {"event_type": None}, {"event_type": None}, {"timestamp": None}]
    )
    alerts = spark.createDataFrame([], "alert_id long, acknowledged int")
    row = stats.overview(events, alerts, datetime(2026, 4, 9, 13)).first()
    assert len(row.severity_breakdown) == 17 and row.critical_events == 1
    assert {(s.value, s["count"]) for s in row.severity_breakdown} == {(s.severity, s["count"]) for s in stats.severity_breakdown(events).collect()}
    assert [(t.value, t["count"]) for t in row.top_event_types] == [(t.event_type, t["count"]) for t in stats.top_event_types(events).collect()]
    assert (None, 2) in [(t.value, t["count"]) for t in row.top_event_types]


@pytest.mark.parametrize("n", [1, 2, 3, 1000, 1001])
def test_newest_keeps_rows_without_time(make_events, n):
    at = datetime(2026, 4, 9, 12)
    events = make_events([{"timestamp": at}, {"timestamp": None}, {"timestamp": at.replace(hour=3)}])
    assert [r.event_id for r in newest(events, n).collect()] == [0, 2, 1][:n]
