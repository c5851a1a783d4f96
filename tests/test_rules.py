from __future__ import annotations

import math
import random
from collections import defaultdict
from datetime import datetime, timedelta
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import rules, sequences
from sparkwarden.operators.normalise import metadata_get

START = datetime(2026, 4, 9, 12)


def simulate(rows, window_us, threshold):
    """The rule's meaning: a buffer per key, one event after the other."""
    fires, buffers = [], defaultdict(list)
    for key, us, row_id in sorted(rows, key=lambda r: (r[1], r[2])):
        buffer = [t for t in buffers[key] if t >= us - window_us] + [us]
        if len(buffer) >= threshold:
            fires.append((key, us, row_id, tuple(buffer[: rules.EVIDENCE])))
            buffer = []
        buffers[key] = buffer
    return sorted(fires)


def fired(spark, rows, window_seconds, threshold):
    df = spark.createDataFrame(rows, "key string, us bigint, event_id bigint").withColumn(
        "timestamp", F.timestamp_micros("us")
    )
    out = rules.fire_and_reset(df, F.col("key"), window_seconds, threshold)
    got = out.select(
        "group_key",
        F.unix_micros("fired_at").alias("us"),
        "fired_id",
        F.transform("evidence", F.unix_micros).alias("e"),
        "matched",
    ).collect()
    assert {r.matched for r in got} <= {threshold}
    return sorted((r.group_key, r.us, r.fired_id, tuple(r.e)) for r in got)


def walk(seed, n, mean_gap_us, keys=3, hot=0.33):
    """Bursts, pauses and ties; one key holds a third of the rows."""
    rng = random.Random(seed)
    us, rows = 1_700_000_000_000_000, []
    for i in range(n):
        us += rng.choice([0, 0, 1, int(rng.expovariate(1 / mean_gap_us))])
        if rng.random() < 0.01:
            us += 30_000_000
        key = "hot" if rng.random() < hot else f"k{rng.randrange(keys)}"
        rows.append((key, us, i))
    return rows


@pytest.mark.parametrize(
    ("seed", "gap", "window", "threshold"),
    [
        (1, 400_000, 2, 4),
        (2, 900_000, 5, 3),
        (3, 100_000, 1, 10),
        (4, 1_500_000, 2, 2),
        (5, 50_000, 3, 50),
        (6, 700_000, 1, 1),
        (7, 330_000, 3, 12),
    ],
)
def test_fires_equal_the_simulation(spark, seed, gap, window, threshold):
    rows = walk(seed, 1500, gap)
    want = simulate(rows, window * 1_000_000, threshold)
    assert want
    assert fired(spark, rows, window, threshold) == want


def test_window_includes_its_edge(spark):
    at = 1_700_000_000_000_000
    inside = [("k", at, 1), ("k", at + 2_000_000, 2)]
    outside = [("k", at, 1), ("k", at + 2_000_001, 2)]
    assert len(fired(spark, inside, 2, 2)) == 1
    assert fired(spark, outside, 2, 2) == []


def test_edge_across_slices(spark):
    slice_us = 2_000_000 * 4
    edge = 1_700_000_000_000_000 // slice_us * slice_us
    rows = [("k", edge - 2_000_000, 1), ("k", edge, 2), ("k", edge + 1, 3), ("k", edge + 2, 4)]
    assert fired(spark, rows, 2, 2) == simulate(rows, 2_000_000, 2)


def test_times_before_1970(spark):
    rows = [("k", -5_000_000 + i * 400_000, i) for i in range(30)]
    assert fired(spark, rows, 1, 3) == simulate(rows, 1_000_000, 3)


def test_same_instant_in_one_key(spark):
    rows = [("k", 1_700_000_000_000_000, i) for i in range(95)]
    assert [r[2] for r in fired(spark, rows, 300, 10)] == list(range(9, 95, 10))


@pytest.mark.parametrize("block", [1, 2, 512])
def test_chains_over_many_slices(spark, block, monkeypatch):
    """A key that never pauses: what a slice leaves for the next one goes through blocks of a chain."""
    monkeypatch.setattr(rules, "CHAIN_BLOCK", block)
    rng, us, rows = random.Random(block), 1_700_000_000_000_000, []
    for i in range(3000):
        # Some 7 rows a window of 4 s; holes come and go, so runs and their places differ.
        us += rng.choice([100_000, 600_000, 900_000, 1_300_000] if i % 50 else [2_000_000])
        rows.append(("hot" if i % 10 else "other", us, i))
    assert fired(spark, rows, 4, 6) == simulate(rows, 4_000_000, 6)


def test_one_key_with_nine_rows_of_ten_stays_out_of_python(spark):
    rows = [("hot" if i % 10 else f"k{i % 7}", 1_700_000_000_000_000 + 300_000 * i, i) for i in range(4000)]
    assert fired(spark, rows, 5, 10) == simulate(rows, 5_000_000, 10)
    df = spark.createDataFrame(rows, "key string, us bigint, event_id bigint").withColumn("timestamp", F.timestamp_micros("us"))
    plan = rules.fire_and_reset(df, F.col("key"), 5, 10)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Python" not in plan and "InArrow" not in plan


def test_rows_without_time_do_not_count(make_events):
    sudo = {"event_type": "sudo_command", "metadata": {"username": "u"}}
    events = make_events([{**sudo, "timestamp": None}, sudo])
    assert rules.match_rules(events).count() == 1
    assert [r.fired_id for r in rules.rule_matches(events).collect()] == [1]


def test_alike_rows_have_alerts_of_their_own(make_events):
    sudo = {"event_type": "sudo_command", "metadata": {"username": "u"}, "event_id": 5}
    failed = {"source_ip": "1.1.1.1", "event_id": 6}
    events = make_events([sudo] * 3 + [failed] * 20)
    alerts = rules.matches_to_alerts(rules.rule_matches(events)).collect()
    assert len(alerts) == 5 and len({a.alert_id for a in alerts}) == 5


def by_rule(matches):
    return sorted((r.rule_id, r.group_key, r.fired_id) for r in matches.collect())


def test_brute_force_fires_once_at_the_tenth(make_events):
    events = make_events([{"source_ip": "192.0.2.1"}] * 10)
    (match,) = rules.rule_matches(events).collect()
    assert (match.rule_id, match.group_key, match.fired_id) == ("BRUTE_001", "192.0.2.1", 9)
    (alert,) = rules.matches_to_alerts(rules.rule_matches(events)).collect()
    assert alert.severity == "high" and alert.acknowledged == 0
    assert alert.event_cluster == ["2026-04-09T12:00:00"] * 10
    assert alert.narrative == (
        "Rule 'SSH Brute Force' triggered: 10 matching events from 192.0.2.1 within 300s "
        "window. Recommended action: flag + auto-block suggestion"
    )


def test_keys_do_not_add_up(make_events):
    events = make_events([{"source_ip": f"10.0.0.{i}"} for i in range(11)])
    assert rules.rule_matches(events).count() == 0


def test_missing_keys_are_unknown(make_events):
    failed = make_events([{"source_ip": None if i % 2 else ""} for i in range(10)])
    assert by_rule(rules.rule_matches(failed)) == [("BRUTE_001", "unknown", 9)]
    sudo = make_events([{"event_type": "sudo_command"}] * 2)
    assert by_rule(rules.rule_matches(sudo)) == [
        ("PRIV_001", "unknown", 0),
        ("PRIV_001", "unknown", 1),
    ]


def test_network_rules(make_events):
    one = {"source": "network", "event_type": "connection_attempt", "source_ip": "10.0.0.1"}
    assert rules.rule_matches(make_events([one])).count() == 0
    many = make_events([one | {"timestamp": START + timedelta(seconds=i)} for i in range(50)])
    found = by_rule(rules.rule_matches(many))
    assert [m for m in found if m[0] == "SCAN_001"] == [("SCAN_001", "10.0.0.1", 49)]
    assert len([m for m in found if m[0] == "EXFIL_001"]) == 16


def test_rule_table(spark):
    ids = [r.rule_id for r in rules.BUILT_IN_RULES]
    assert len(set(ids)) == 4
    by_id = {r.rule_id: r for r in rules.BUILT_IN_RULES}
    assert (by_id["BRUTE_001"].window_seconds, by_id["BRUTE_001"].threshold) == (300, 10)
    assert by_id["PRIV_001"].severity == "critical"
    assert rules.load_rules(rules.rules_table(spark)) == list(rules.BUILT_IN_RULES)
    with pytest.raises(ValueError):
        rules.check_rules([by_id["BRUTE_001"]] * 2)
    with pytest.raises(ValueError):
        rules.Rule("X", "x", "true", "'k'", "high", "", 0, 1)


def test_user_rule_and_disabled_rule(make_events):
    own = rules.Rule("MINE", "Mine", "raw_message like '%1'", rules.GLOBAL, "medium", "look", 60, 2)
    off = rules.Rule("OFF", "Off", "true", rules.GLOBAL, "medium", "", 60, 1, enabled=False)
    events = make_events([{} for _ in range(25)])
    assert by_rule(rules.rule_matches(events, [own, off])) == [("MINE", "global", 11)]
    tagged = rules.match_rules(events, [own, off])
    assert sorted(r.event_id for r in tagged.collect()) == [1, 11, 21]


def test_recent_matches_newest_first(make_events):
    events = make_events(
        [
            {"event_type": "sudo_command", "timestamp": START + timedelta(seconds=i)}
            for i in range(120)
        ]
    )
    recent = rules.recent_matches(rules.rule_matches(events)).collect()
    assert [r.fired_id for r in recent] == list(range(119, 19, -1))


def network(make_events, rows):
    return make_events(
        [
            {
                "timestamp": datetime(2023, 11, 14) + timedelta(microseconds=us % 10**12),
                "source": "network",
                "source_ip": key,
                "dest_port": port,
            }
            for key, us, port in rows
        ]
    )


def test_rolling_count_equals_brute_force(make_events):
    rows = walk(11, 600, 800_000)
    events = network(make_events, [(k, us, 1) for k, us, _ in rows])
    got = {
        r.event_id: r.rolling
        for r in sequences.rolling_count(events, F.col("source_ip"), 3).collect()
    }
    want = {
        i: sum(1 for k2, t2, _ in rows if k2 == k and t - 3_000_000 <= t2 <= t)
        for i, (k, t, _) in enumerate(rows)
    }
    assert got == want


@pytest.mark.parametrize(("seed", "window", "ports"), [(21, 2, 6), (22, 1, 3), (23, 7, 12)])
def test_distinct_in_window_equals_brute_force(make_events, seed, window, ports):
    rng = random.Random(seed)
    rows = [(k, us, rng.randrange(ports)) for k, us, _ in walk(seed, 600, 500_000)]
    found = sequences.distinct_in_window(
        network(make_events, rows), F.col("source_ip"), F.col("dest_port"), window, 2
    )
    got = {r.event_id: r.distinct_items for r in found.collect()}
    want = {}
    for i, (k, t, _) in enumerate(rows):
        seen = {p for k2, t2, p in rows if k2 == k and t - window * 1_000_000 <= t2 <= t}
        if len(seen) > 2:
            want[i] = len(seen)
    assert want and got == want


def test_port_scan_needs_more_than_the_threshold(make_events):
    def scan(n):
        rows = [("10.0.0.9", i * 1000, i) for i in range(n)] + [("10.0.0.9", n * 1000, 0)]
        return sequences.distinct_in_window(
            network(make_events, rows), F.col("source_ip"), F.col("dest_port")
        ).collect()

    assert scan(50) == []
    assert {r.distinct_items for r in scan(51)} == {51}


def test_followed_by(make_events):
    at = [
        ("sudo_failed", "ann", 0),
        ("sudo_command", "bob", 10),
        ("sudo_command", "ann", 180),
        ("sudo_command", "ann", 181),
        ("sudo_failed", "ann", 1000),
        ("other", "ann", 1001),
        ("sudo_failed", "ann", 1002),
        ("sudo_command", "ann", 1002),
    ]
    events = make_events(
        [
            {
                "event_type": kind,
                "metadata": {"username": user},
                "timestamp": START + timedelta(seconds=s),
            }
            for kind, user, s in at
        ]
    )
    found = sequences.followed_by(
        events,
        F.col("event_type") == "sudo_failed",
        F.col("event_type") == "sudo_command",
        metadata_get("username"),
    )
    got = {r.event_id: (r.first_at - START).seconds for r in found.collect()}
    assert got == {2: 0, 7: 1002}


def test_deviation_from_own_past(make_events):
    amounts = [100.0 + i % 5 for i in range(40)] + [500.0, 101.0]
    events = make_events(
        [
            {"timestamp": START + timedelta(hours=i), "metadata": {"bytes": str(a)}}
            for i, a in enumerate(amounts)
        ]
        + [{"timestamp": START + timedelta(hours=5), "source_ip": "young",
            "metadata": {"bytes": "9999"}}]
    )
    found = sequences.deviation_from_baseline(
        events, F.coalesce("source_ip", F.lit("h")), metadata_get("bytes", None).cast("double")
    ).collect()
    assert [(r.host, r.bucket, r.total) for r in found] == [
        ("h", START + timedelta(hours=40), 500.0)
    ]


@pytest.mark.parametrize(("history", "offset"), [(3, 0.0), (7, 1e12), (100, 1e9)])
def test_deviation_equals_brute_force_and_keeps_precision(spark, history, offset):
    """Every past worked out anew with exact fractions; large totals lose nothing."""
    rng = random.Random(history)
    rows = [(f"h{i % 2}", i, offset + rng.choice([1.0, 2.0, 4.5, 30.0])) for i in range(300)]
    totals = spark.createDataFrame(rows, "host string, bucket int, total double")
    got = {(r.host, r.bucket): r for r in sequences.deviating_buckets(totals, 1.5, history, 3).collect()}
    want = {}
    for h in ("h0", "h1"):
        series = [(b, t) for host, b, t in rows if host == h]
        for i, (b, t) in enumerate(series):
            past = [Fraction(x) for _, x in series[max(0, i - history) : i]]
            if len(past) >= 3:
                mean = sum(past) / len(past)
                std = math.sqrt(sum((x - mean) ** 2 for x in past) / len(past))
                if float(Fraction(t) - mean) > 1.5 * std:
                    want[h, b] = (len(past), float(mean), std)
    assert got.keys() == want.keys() and len(want) > 10
    for k, (n, mean, std) in want.items():
        assert got[k].samples == n and math.isclose(got[k].mean, mean, rel_tol=1e-12) and math.isclose(got[k].std, std, rel_tol=1e-3)


def test_no_window_over_a_whole_key(make_events):
    """Windows over events are cut by time slice; only per-slice rows meet per key."""
    events = make_events([{}])
    plans = [
        rules.rule_matches(events, [rules.BUILT_IN_RULES[0]]),
        sequences.rolling_count(events, F.col("source_ip"), 60),
    ]
    for df in plans:
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "SinglePartition" not in plan
    plan = plans[1]._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(_key" in plan and "_slice" in plan
