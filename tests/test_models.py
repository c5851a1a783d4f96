from __future__ import annotations

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.dns import shannon_entropy
from sparkwarden.operators import dns, forest, login, traffic
from sparkwarden.operators.alerts import dns_alerts, login_alerts, traffic_alerts
from sparkwarden.plans.detect import with_progress


def domains(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "domain string")


def entropy_of(text):
    return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())


def test_entropy(spark):
    texts = ["", "aaaa", "abcdefghijklmnop", "search", "q7w8e9r0t1y2u3i4o5p6", "a.b$c\\"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(shannon_entropy(F.col("t"))).collect()]
    assert got[0] == got[1] == 0.0
    assert got[2] == pytest.approx(4.0)
    for text, value in zip(texts[1:], got[1:], strict=True):
        assert value == pytest.approx(entropy_of(text), abs=1e-12)


@pytest.mark.parametrize(
    ("domain", "suspicious", "has_hex"),
    [
        ("mail.shop.example", False, False),
        ("q7w8e9r0t1y2u3i4o5p6a7s8d9.bad.example", True, False),
        ("0123456789abcdef0123456789abcdef.c2.example", True, True),
        ("0123456789abcdef.example", True, True),
        ("k3v9.example", False, False),
    ],
)
def test_dns_analysis(spark, domain, suspicious, has_hex):
    row = dns.dns_analysis(domains(spark, domain)).first()
    assert (row.suspicious, row.has_hex_encoding) == (suspicious, has_hex)
    assert row.subdomain_length == len(domain.split(".")[0])


@pytest.mark.parametrize(
    ("domain", "label", "confidence"),
    [
        ("mail.shop.example", "normal", 0.90),
        ("0123456789abcdef0123456789abcdef.c2.example", "tunneling_suspect", 0.85),
        ("0123456789abcdef.c2.example", "dga_suspect", 0.70),
        ("x1c3v5b7n9m2a4s6d8f.bot.example", "dga_suspect", 0.70),
        ("qwertyuiopasdfghjklzxcv.bot.example", "tunneling_suspect", 0.65),
        ("", "normal", 0.90),
    ],
)
def test_dns_heuristic(spark, domain, label, confidence):
    row = dns.classify_dns(domains(spark, domain)).first()
    assert (row.label, row.confidence) == (label, confidence)
    assert set(row.features) == set(dns.FEATURES)


def test_dns_features(spark):
    row = dns.dns_features(domains(spark, "aB1.longer-label.x.example")).first()
    assert row.digit_ratio == pytest.approx(1 / 3)
    assert row.consonant_ratio == pytest.approx(1 / 3)
    assert (row.dot_count, row.max_label_length, row.total_length) == (2, 12, 26)
    bare = dns.dns_features(domains(spark, "localhost")).first()
    assert (bare.dot_count, bare.max_label_length) == (0, 0)


def test_dns_forest_learns_the_labels(spark):
    rng = random.Random(1)
    normal = [f"www.site{i}.example" for i in range(40)]
    hexed = ["".join(rng.choices("0123456789abcdef", k=24)) + ".c2.example" for _ in range(40)]
    labelled = dns.classify_dns(domains(spark, *normal, *hexed)).select("domain", "label")
    # An observation in the session must not get in the way of the model.
    with_progress(labelled)[0].collect()
    model = dns.fit_dns_forest(labelled, n_trees=10)
    assert model.labels == ("normal", "tunneling_suspect")
    out = dns.classify_dns(domains(spark, "www.site99.example", "deadbeef" * 3 + ".c2.example"), model)
    got = {r.domain[:3]: (r.label, r.confidence > 0.5) for r in out.collect()}
    assert got == {"www": ("normal", True), "dea": ("tunneling_suspect", True)}
    assert dns.fit_dns_forest(labelled.limit(19)) is None


def logins(make_events, rows):
    return make_events(
        [
            {
                "timestamp": ts,
                "source_ip": ip,
                "event_type": "ssh_success" if ok else "ssh_failed",
                "metadata": {"username": user} if user else {},
            }
            for ts, ip, user, ok in rows
        ]
    )


def test_login_features(make_events):
    rows = [
        (datetime(2026, 4, 9, 14, 30), "10.0.0.1", "root", False),
        (datetime(2026, 4, 11, 3), None, None, True),
    ]
    other = make_events([{"event_type": "sudo_command"}, {"source": "dns"}])
    events = logins(make_events, rows).unionByName(other)
    a, b = login.login_features(events).orderBy("event_id").collect()
    assert (a.hour_of_day, a.day_of_week, a.is_weekend, a.auth_success) == (14, 3, 0, 0)
    assert (b.is_weekend, b.auth_success) == (1, 1)
    assert b.source_ip_hash == b.username_hash != a.username_hash


def baseline(make_events):
    return logins(
        make_events,
        [
            (datetime(2026, 4, 7, h, 5 * k), "10.0.0.1", "root", True)
            for h in range(9, 18)
            for k in range(5)
        ],
    )


def test_login_model(make_events):
    as_of = datetime(2026, 4, 8)
    model = login.fit_login_model(baseline(make_events), as_of)
    usual = logins(make_events, [(datetime(2026, 4, 8, 10), "10.0.0.1", "root", True)])
    odd = logins(make_events, [(datetime(2026, 4, 12, 3), "203.0.113.9", "guest", False)])
    low = login.score_logins(usual, model).first().anomaly_score
    high = login.score_logins(odd, model).first().anomaly_score
    assert 0 <= low < high <= 1 and low < 0.8
    assert login.fit_login_model(baseline(make_events), as_of, baseline_days=0) is None
    untrained = forest.predict_anomaly(login.score_logins(usual, None)).first()
    assert (untrained.anomaly_score, untrained.is_anomaly) == (0.0, False)


def test_too_few_logins(make_events):
    few = logins(make_events, [(datetime(2026, 4, 7, 1), "a", "b", True)] * 9)
    assert login.fit_login_model(few, datetime(2026, 4, 8)) is None


def test_login_alert_text(make_events):
    scored = logins(
        make_events, [(datetime(2026, 4, 9), "10.0.0.1", "root", False)] * 2
    ).withColumn("anomaly_score", F.when(F.col("event_id") == 0, 0.7).otherwise(0.69))
    (alert,) = login_alerts(scored).collect()
    assert alert.narrative.startswith(
        "Anomalous login detected (score: 0.70). Source IP: 10.0.0.1, User: root."
    )
    assert alert.severity == "high" and alert.event_cluster == ["2026-04-09T00:00:00"]


def test_dns_alert_text(make_events):
    queries = make_events(
        [
            {"source": "dns", "event_type": "dns_query", "metadata": {"domain": d}}
            for d in ("0123456789abcdef" * 2 + ".c2.example", "www.example.org", "")
        ]
    )
    (alert,) = dns_alerts(dns.classify_dns(dns.dns_queries(queries))).collect()
    assert alert.severity == "high"
    assert "tunneling_suspect (confidence: 85%). Subdomain entropy: 4.00." in alert.narrative


def cloud(spark, n, planted=()):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (n, 2)))]
    rows += [(n + i, *p) for i, p in enumerate(planted)]
    return spark.createDataFrame(rows, "id bigint, a double, b double")


def test_forest_finds_planted_rows(spark):
    df = cloud(spark, 1500, [(9.0, -9.0), (-10.0, 10.0)])
    model = forest.fit_isolation_forest(df, ["a", "b"], "id", 10)
    scored = forest.predict_anomaly(forest.score_isolation_forest(df, model))
    rows = sorted(scored.collect(), key=lambda r: -r.anomaly_score)
    assert {rows[0].id, rows[1].id} == {1500, 1501}
    assert all(0 <= r.anomaly_score <= 1 for r in rows)
    assert sum(r.is_anomaly for r in rows) / len(rows) == pytest.approx(0.05, abs=0.01)


def test_forest_does_not_depend_on_partitions(spark):
    df = cloud(spark, 600)
    one = forest.fit_isolation_forest(df.coalesce(1), ["a", "b"], "id", 10, n_trees=20)
    many = forest.fit_isolation_forest(df.repartition(7, "a"), ["a", "b"], "id", 10, n_trees=20)
    assert one.nodes.equals(many.nodes) and one.offset == many.offset


@pytest.mark.parametrize(("n", "trees"), [(300, 40), (4000, 10)])
def test_forest_sample_sizes(spark, n, trees):
    """Both ways of sampling give each tree its rows: shared small table, own rows."""
    model = forest.fit_isolation_forest(
        cloud(spark, n), ["a", "b"], "id", 10, n_trees=trees, sample_size=64
    )
    sizes = model.nodes.groupby("tree")["sample_size"].first()
    assert len(sizes) == trees and sizes.min() >= 48 and sizes.max() == 64
    assert (model.nodes["depth"] <= 6).all()
    roots = model.nodes[model.nodes["node"] == 0]
    assert (roots["size"] == roots["sample_size"]).all()


def test_forest_of_equal_rows(spark):
    df = spark.createDataFrame([(i, 1.0, 2.0) for i in range(50)], "id bigint, a double, b double")
    model = forest.fit_isolation_forest(df, ["a", "b"], "id", 10)
    scores = {r.anomaly_score for r in forest.score_isolation_forest(df, model).collect()}
    assert len(scores) == 1 and scores.pop() == pytest.approx(0.5, abs=1e-5)


def test_forest_is_stored(spark, tmp_path):
    df = cloud(spark, 200)
    model = forest.fit_isolation_forest(df, ["a", "b"], "id", 10, n_trees=5)
    forest.save_forest(spark, model, str(tmp_path / "m"))
    back = forest.load_forest(spark, str(tmp_path / "m"))
    assert back.columns == model.columns and back.offset == model.offset
    assert sorted(forest.score_isolation_forest(df, back).collect()) == sorted(
        forest.score_isolation_forest(df, model).collect()
    )


NORMAL = (100.0, 50000.0, 5, 3, 0.8, 0.2)
SNAPSHOT = "window_start timestamp, " + ", ".join(
    f"{f} {'bigint' if f.startswith('unique') else 'double'}" for f in traffic.TRAFFIC_FEATURES
)


def snapshots(spark, rows):
    start = datetime(2026, 4, 1)
    return spark.createDataFrame(
        [(start + timedelta(hours=i), *r) for i, r in enumerate(rows)], SNAPSHOT
    )


def test_no_baseline_no_flags(spark):
    now = snapshots(spark, [NORMAL])
    for past in (now.limit(0), snapshots(spark, [NORMAL] * 29)):
        row = traffic.analyze_traffic(
            snapshots(spark, [(100.0, 50000.0, 5, 500, 0.8, 0.2)]), traffic.baseline_stats(past)
        ).first()
        assert (row.is_anomalous, row.zscore_flags) == (False, [])
        assert row.description == "Normal traffic pattern"


def test_a_baseline_is_one_row(spark):
    now = snapshots(spark, [NORMAL])
    baseline = traffic.baseline_stats(snapshots(spark, [NORMAL] * 50))
    with pytest.raises(Exception, match="a baseline is one row"):
        traffic.zscore_flags(now, baseline.unionByName(baseline)).collect()
    assert [r.zscore_flags for r in traffic.zscore_flags(now, baseline.limit(0)).collect()] == [[]]


def test_port_spike_is_flagged(spark):
    stats = traffic.baseline_stats(snapshots(spark, [NORMAL] * 50))
    spike = snapshots(spark, [(100.0, 50000.0, 5, 500, 0.8, 0.2)])
    row = traffic.analyze_traffic(spike, stats).first()
    assert row.zscore_flags == ["unique_dest_ports (497.0σ)"]
    assert (row.anomaly_score, row.is_anomalous) == (0.3, False)
    assert row.description == "Statistical outliers: unique_dest_ports (497.0σ)"
    double = snapshots(spark, [(900.0, 50000.0, 5, 500, 0.8, 0.2)])
    (alert,) = traffic_alerts(traffic.analyze_traffic(double, stats)).collect()
    assert alert.severity == "high" and "unique_dest_ports" in alert.narrative


def test_forest_score_joins_in(spark):
    rng = random.Random(2)
    past = snapshots(
        spark,
        [
            (100 + rng.random(), 5e4 + 100 * rng.random(), 5, 3, 0.8, 0.2)
            for _ in range(60)
        ],
    )
    model = traffic.fit_traffic_model(past)
    odd = snapshots(spark, [(500.0, 9e5, 90, 700, 0.1, 0.9)])
    row = traffic.analyze_traffic(odd, traffic.baseline_stats(past), model, limit=1e9).first()
    assert row.anomaly_score == row.forest_score > 0.5 and row.is_anomalous
    assert row.description == f"Multi-feature anomaly score: {row.forest_score:.2f}"
    assert traffic.fit_traffic_model(past.limit(29)) is None


def test_snapshots(make_events):
    rows = [
        {
            "timestamp": datetime(2026, 4, 9, i % 2, i),
            "source": "network",
            "source_ip": "a",
            "dest_ip": f"10.0.0.{i % 5}",
            "dest_port": None if i == 0 else i % 7,
            "metadata": {"protocol": "udp" if i % 4 == 0 else "tcp", "bytes": "36"},
        }
        for i in range(40)
    ] + [{"timestamp": datetime(2026, 4, 9, 5), "source": "network"}]
    exact = traffic.traffic_snapshots(make_events(rows)).orderBy("window_start").collect()
    first, _, bare = exact
    assert first.packets_per_second == pytest.approx(20 / 3600)
    assert first.bytes_per_second == pytest.approx(0.2)
    assert (first.unique_dest_ips, first.unique_dest_ports) == (5, 7)
    assert (first.tcp_ratio, first.udp_ratio) == (0.5, 0.5)
    assert (bare.unique_dest_ips, bare.tcp_ratio, bare.bytes_per_second) == (0, 0.0, 0.0)
    by_host = traffic.traffic_snapshots(make_events(rows), by=F.col("source_ip")).collect()
    assert len(by_host) == 3
