"""Structures that are stored for later reads: text index, roll-ups, Bloom filters, buckets; and sessions."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import alerts, narratives, rollups, search, stats, textindex
from sparkwarden.operators.search import TextQuery
from sparkwarden.sources import tables

START = datetime(2026, 4, 9, 12)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Text index ----------------------------------------------------------------------------

TEXTS = [
    None, "", "...", "the quick brown fox", "The quick, brown fox jumps", "brown the quick", "quick quick brown",
    "Réau côté 10.0.0.1", "10.0.0.10 quick", "a b a b a c", "foxes quickly", "quick\nbrown\tfox", "b a b",
]
QUERIES = [
    TextQuery(all_of=["quick"]), TextQuery(all_of=["brown", "the"]), TextQuery(phrase="quick brown"), TextQuery(phrase="a b a"),
    TextQuery(all_of=["10.0.0.1"]), TextQuery(any_of=["reau", "jumps", "a c"]), TextQuery(none_of=["quick"]),
    TextQuery(all_of=["fox"], none_of=["the quick", "!!"]), TextQuery(prefix="qui"), TextQuery(prefix="quick bro"),
    TextQuery(all_of=["nothing"]), TextQuery(phrase="fox nothing"), TextQuery(), TextQuery(none_of=["nothing"]),
    TextQuery(all_of=["COTE"], any_of=["10.0.0.1", "zzz"], prefix="ré"),
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """Null and repeated ids, repeated rows, written in two segments."""
    rows = [(None if i % 3 == 0 else i % 4, t, i % 2) for i, t in enumerate(TEXTS)] + [(1, TEXTS[3], 1)] * 2
    df = spark.createDataFrame(rows, "event_id long, raw_message string, row int")
    path = str(tmp_path_factory.mktemp("index"))
    textindex.write_text_index(df.limit(6), path)
    textindex.write_text_index(df.subtract(df.limit(6)).unionByName(df.limit(0)), path)
    both = df.limit(6).unionByName(df.subtract(df.limit(6)))
    return both, path


@pytest.mark.parametrize("k", range(len(QUERIES)))
def test_index_gives_what_a_scan_gives(spark, indexed, k):
    df, path = indexed
    got = textindex.text_index_search(spark, path, QUERIES[k])
    assert got.columns == df.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, search.text_search(df, QUERIES[k]).collect()))


def test_no_text_is_read(spark, indexed):
    _, path = indexed
    found = textindex.text_index_search(spark, path, TextQuery(phrase="quick brown", all_of=["the"], none_of=["jumps"]))
    plan = plan_of(found.select("event_id"))
    assert "raw_message" not in plan and "LeftAnti" in plan
    assert "PartitionFilters: [isnotnull(folder" in plan or "folder#" in plan.split("PartitionFilters")[1]


def test_rarest_word_comes_first(spark, indexed):
    _, path = indexed
    counts = textindex.word_rows(spark, path, ["quick", "jumps", "nothing"])
    assert counts["nothing"] == 0 and counts["jumps"] == 1 and counts["quick"] > 5
    plan = textindex.text_index_search(spark, path, TextQuery(all_of=["quick", "jumps"]))._jdf.queryExecution().analyzed().toString()
    assert plan.index("= jumps") < plan.index("= quick")


# Roll-ups -------------------------------------------------------------------------------


def happened(make_events, rng, n, hours=40):
    return make_events(
        [
            {
                "event_id": i, "timestamp": START + timedelta(seconds=rng.randint(0, hours * 3600)),
                "severity": rng.choice(["info", "low", "medium", "high", "critical"]),
                "source_ip": rng.choice([None, "10.0.0.1", "10.0.0.2", "10.0.0.3"]), "event_type": rng.choice(["a", "b", None]),
            }
            for i in range(n)
        ]
    )


def test_rollups_equal_the_events(spark, make_events, tmp_path):
    rng = random.Random(6)
    # The second wave is older than the first: late events count.
    waves = [happened(make_events, rng, 300), happened(make_events, rng, 200, hours=3)]
    folder, path = str(tmp_path / "in"), str(tmp_path / "counts")
    assert rollups.read_rollup(spark, path).count() == 0
    for wave in waves:
        wave.write.mode("append").parquet(folder)
        streamed = spark.readStream.schema(wave.schema).parquet(folder)
        rollups.run_rollup_stream(streamed, path, str(tmp_path / "check")).awaitTermination()
    events, rollup = spark.read.parquet(folder), rollups.read_rollup(spark, path)
    state = spark.createDataFrame([(1, 0), (2, 1)], "alert_id long, acknowledged int")
    for as_of in (START + timedelta(hours=30), START + timedelta(hours=2, minutes=41, microseconds=7)):
        want = stats.overview(events, state, as_of)
        assert rollups.overview(rollup, events, state, as_of).select(*want.columns).first() == want.first()
        got = rollups.heatmap(rollup, events, as_of + timedelta(days=6), 6).collect()
        assert got == stats.heatmap(events, as_of + timedelta(days=6), 6).collect() and len(got) > 5
    assert rollups.timeline(rollup, include_low=True).collect() == stats.timeline(events, include_low=True).collect()


def test_only_the_open_hour_of_events_is_read(spark, make_events, tmp_path):
    events = happened(make_events, random.Random(7), 50)
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    stored = tables.read_events(spark, path)
    rows = rollups.since(rollups.roll_up(events), stored, START + timedelta(hours=3, minutes=20))
    assert "event_date" in plan_of(rows).split("PartitionFilters")[1]
    whole = rollups.since(rollups.roll_up(events), stored, START + timedelta(hours=3))
    assert "FileScan" not in plan_of(whole)


# Lookups and buckets -----------------------------------------------------------------------


def test_a_lookup_skips_row_groups_by_bloom_filter(spark, make_events, tmp_path):
    """Ids without order: their ranges overlap in all files, so only the filters can tell."""
    path = str(tmp_path / "events")
    for part in range(6):
        rows = [{"event_id": (i * 7919 + part) % 100003, "source_ip": f"10.{part}.0.{i % 50}"} for i in range(part, 3000, 6)]
        tables.write_events(make_events(rows).coalesce(1), path)
    stored = tables.read_events(spark, path)
    wanted = (1200 * 7919) % 100003

    def scanned(df):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        while not plan.nodeName().startswith("Scan"):
            plan = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.children().apply(0)
        return plan.metrics().apply("numOutputRows").value()

    assert 0 < scanned(stored.filter(F.col("event_id") == wanted).select("event_id")) <= 1500 < scanned(stored.select("event_id"))
    assert scanned(stored.filter(F.col("event_id") == 55555555).select("event_id")) == 0
    assert scanned(stored.filter(F.col("source_ip") == "10.3.0.9").select("source_ip")) == 500


def test_acknowledging_moves_no_alert(spark, tmp_path):
    made = spark.createDataFrame([(i, 0) for i in range(50)], "alert_id long, acknowledged int")
    acks = spark.createDataFrame([(3,), (3,), (7,), (99,)], "alert_id long")
    name = f"t{time.time_ns()}"
    tables.write_alert_table(made, f"{name}_alerts", str(tmp_path / "alerts"), 4)
    tables.write_alert_table(acks, f"{name}_acks", str(tmp_path / "acks"), 4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        state, unknown = alerts.acknowledge(spark.table(f"{name}_alerts"), spark.table(f"{name}_acks"))
        assert "Exchange" not in plan_of(state)
        assert sorted(r.alert_id for r in state.filter("acknowledged = 1").collect()) == [3, 7]
        assert [r.alert_id for r in unknown.collect()] == [99]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# Sessions ---------------------------------------------------------------------------------


def sessions_of(rows, gap):
    """Literal sessions: sorted by time, a new one after more than the gap."""
    out = []
    for key in sorted({r["source_ip"] for r in rows}):
        mine = sorted((r for r in rows if r["source_ip"] == key), key=lambda r: (r["timestamp"], r["event_id"]))
        begin = 0
        for i in range(1, len(mine) + 1):
            if i == len(mine) or mine[i]["timestamp"] - mine[i - 1]["timestamp"] > gap:
                out.append((key, mine[begin]["timestamp"], i - begin, mine[begin]["event_type"]))
                begin = i
    return sorted(out)


def test_sessions_on_a_table_and_on_a_stream(spark, make_events, tmp_path):
    rng, gap = random.Random(9), timedelta(minutes=5)
    rows, now = [], START
    for i in range(400):
        # A gap of exactly five minutes still joins; a microsecond more does not.
        now += rng.choice([timedelta(0), timedelta(seconds=40), gap / 2, gap + timedelta(microseconds=1)])
        rows.append({"event_id": i, "timestamp": now, "source_ip": "hot" if i % 3 else "b", "event_type": f"t{i % 5}"})
    rows += [{"event_id": 900 + i, "timestamp": START + i * gap, "source_ip": "edge"} for i in range(4)]
    events = make_events(rows)
    columns = ["cluster_key", "window_start", "count", "event_type"]
    full = [{**r, "event_type": r.get("event_type", "ssh_failed")} for r in rows]
    batch = narratives.session_clusters(events.unionByName(make_events([{"timestamp": None}])), F.col("source_ip"), 5)
    assert sorted(map(tuple, batch.select(*columns).collect())) == sessions_of(full, gap)
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    make_events([{"event_id": -1, "timestamp": now + timedelta(days=9), "source_ip": "clock"}]).write.mode("append").parquet(path)
    streamed = spark.readStream.schema(events.schema).parquet(path).withWatermark("timestamp", "1 minute")
    found = narratives.session_clusters(streamed, F.col("source_ip"), 5)
    query = found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).option("path", str(tmp_path / "out"))
    query.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(found.schema).parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.select(*columns).collect())) == sessions_of(full, gap)
    assert sorted(r.window_minutes for r in got.collect()) == sorted(r.window_minutes for r in batch.collect())
