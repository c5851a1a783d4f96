from __future__ import annotations

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparkwarden.operators import narratives, rules, sequences, stats, traffic
from sparkwarden.operators.normalise import metadata_get, parse_auth, split_parsed
from sparkwarden.plans.detect import (
    detect,
    score_events,
    store_log_streams,
    store_logs,
    stored_logs,
    with_progress,
)
from sparkwarden.plans.fixtures import time_sentinel
from sparkwarden.session import shared_dir
from sparkwarden.sources import logs, tables
from sparkwarden.streaming import jobs, rule_batches, sliding
from sparkwarden.streaming.rules import stream_rule_matches
from sparkwarden.streaming.sequences import stream_followed_by

START = datetime(2026, 4, 9, 12)


def clusters(make_events, event_type="ssh_failed", n=5, **more):
    events = make_events(
        [
            {
                "timestamp": START + timedelta(seconds=i),
                "event_type": event_type,
                "source_ip": "10.0.0.1",
                "dest_port": 22,
                **more,
            }
            for i in range(n)
        ]
    )
    return narratives.event_clusters(events, F.col("source_ip"), 5)


def told(df):
    return df.transform(narratives.narrate).first().narrative


def test_narratives_carry_the_facts(make_events):
    text = told(clusters(make_events))
    assert all(fact in text for fact in ("10.0.0.1", "5", "22"))
    assert "brute" in told(clusters(make_events, "ssh_brute_force")).lower()
    dns = clusters(make_events, "dns_query").withColumn("attack_type", F.lit("tunnelling"))
    assert "DNS" in told(dns) and "tunnelling" in told(dns)
    other = told(clusters(make_events, "odd_thing", dest_port=None))
    assert all(fact in other for fact in ("odd_thing", "medium", "suspicious activity"))


def test_narrative_defaults(make_events):
    bare = clusters(make_events, source_ip=None, dest_port=None).drop("window_minutes")
    assert all(f in told(bare) for f in ("unknown source", "N/A", "unknown minutes"))
    none = clusters(make_events).withColumn("count", F.lit(0))
    assert told(none) == "No events to analyze."


def test_cluster_takes_its_first_event(make_events):
    events = make_events(
        [
            {"event_type": "b", "timestamp": START, "source_ip": "x"},
            {"event_type": "a", "timestamp": START, "source_ip": "x"},
            {"event_type": "c", "timestamp": START - timedelta(hours=1), "source_ip": "x"},
        ]
    )
    rows = narratives.event_clusters(events, F.col("source_ip"), 5).orderBy("window_start")
    assert [(r["count"], r.event_type) for r in rows.collect()] == [(1, "c"), (2, "b")]


def test_digest(make_events):
    events = make_events(
        [{"timestamp": START + timedelta(seconds=30 - i), "raw_message": "m" * 200} for i in range(30)]
    )
    (row,) = narratives.cluster_digest(events, F.lit("all"), 60, n=3).collect()
    lines = row.digest.split("\n")
    assert lines[0] == "[2026-04-09 12:00:01] MEDIUM ssh_failed from local: " + "m" * 120
    assert len(lines) == 3


def brute(n=10, ip="192.0.2.1", at=START):
    return [{"source_ip": ip, "timestamp": at + timedelta(seconds=i)} for i in range(n)]


def test_detect_unites_all_detectors(make_events):
    rows = brute() + [
        {"source": "dns", "event_type": "dns_query",
         "metadata": {"domain": "0123456789abcdef" * 2 + ".c2.example"}},
        {"event_type": "sudo_command", "metadata": {"username": "ann"}},
    ]
    alerts = detect(make_events(rows)).collect()
    assert sorted(a.severity for a in alerts) == ["critical", "high", "high"]
    assert len({a.alert_id for a in alerts}) == 3


def test_alerts_are_the_same_in_every_run(make_events, spark, tmp_path):
    first = detect(make_events(brute(25)).repartition(5))
    again = detect(make_events(brute(25)))
    assert sorted(first.collect()) == sorted(again.collect())
    tables.write_alerts(first, str(tmp_path / "alerts"))
    stored = tables.read_alerts(spark, str(tmp_path / "alerts"))
    assert stored.count() == 2
    assert stats.open_alerts(stored).first().open_alerts == 2


def test_score_events_keeps_all_events(make_events):
    events = make_events(brute(3) + [{"source": "dns", "event_type": None}])
    assert sorted(score_events(events, None).collect()) == sorted(events.collect())


def test_progress(make_events):
    watched, seen = with_progress(make_events(brute(7)))
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"events_processed": 7}


class Session:
    """The parts of a session that decide on the shared folder."""

    def __init__(self, master, setting=None):
        self.conf = {"spark.checkpoint.dir": setting} if setting else {}
        self.sparkContext = self
        self.master = master

    def getCheckpointDir(self):
        return None


def test_shared_dir_follows_the_session():
    assert shared_dir(Session("yarn", "/shared/place/"), "x").startswith("/shared/place/x-")
    with pytest.raises(ValueError):
        shared_dir(Session("yarn"), "x")


# Streams -------------------------------------------------------------------------------


def store(events, path, *bounds):
    """Write events as one file per time span, in time order."""
    edges = [datetime(1970, 1, 2), *bounds, datetime(2100, 1, 1)]
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = events.filter((F.col("timestamp") >= F.lit(lo)) & (F.col("timestamp") < F.lit(hi)))
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)


def stream(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(spark, df, work):
    query = jobs.append_stream(df, f"{work}/out", f"{work}/checkpoint")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{work}/out"), query


def mixed(make_events, n=240):
    kinds = ["ssh_failed", "ssh_brute_force", "sudo_command", "connection_attempt"]
    return make_events(
        [
            {
                "timestamp": START + timedelta(seconds=7 * (i // 2) + 900 * (i // 80)),
                "event_type": kinds[i % 4],
                "source": "network" if i % 4 == 3 else "auth",
                "source_ip": ["a", "a", None][i % 3],
                "metadata": {"username": f"u{i % 2}"},
            }
            for i in range(n)
        ]
    )


def test_stream_equals_batch(spark, make_events, tmp_path):
    events = mixed(make_events)
    path = str(tmp_path / "in")
    store(events.unionByName(time_sentinel(events)), path,
          START + timedelta(minutes=3), START + timedelta(minutes=20), START + timedelta(days=1))
    out, query = run(
        spark, stream_rule_matches(stream(spark, path, events.schema), delay="1 minute"),
        str(tmp_path)
    )
    want = rules.rule_matches(events)
    assert sorted(out.select(*want.columns).collect()) == sorted(want.collect())
    assert {r.rule_id for r in out.collect()} == {"BRUTE_001", "PRIV_001", "EXFIL_001"}
    assert jobs.late_rows(query) == 0


def test_stream_resumes_from_its_checkpoint(spark, make_events, tmp_path):
    events = make_events(brute(14))
    path = str(tmp_path / "in")
    store(events.limit(6), path)
    fires = stream_rule_matches(stream(spark, path, events.schema), [rules.BUILT_IN_RULES[0]], "0 seconds")
    out, _ = run(spark, fires, str(tmp_path))
    assert out.count() == 0
    store(events.filter("event_id >= 6").unionByName(time_sentinel(events)), path,
          START + timedelta(hours=1))
    out, query = run(spark, fires, str(tmp_path))
    assert [r.fired_id for r in out.collect()] == [9]
    assert jobs.events_processed(query) == 9


def test_late_events_are_counted_not_used(spark, make_events, tmp_path):
    on_time = make_events(brute(9) + [{"source_ip": "z", "timestamp": START + timedelta(hours=2)}])
    late = make_events(brute(1)).withColumn("event_id", F.lit(50).cast("bigint"))
    path = str(tmp_path / "in")
    later = on_time.filter("source_ip = 'z'").withColumn("event_id", F.lit(51).cast("bigint"))
    # The first two batches move the watermark, which then holds for the third.
    for part in (on_time, later, late):
        store(part, path)
    out, query = run(
        spark,
        stream_rule_matches(stream(spark, path, on_time.schema), [rules.BUILT_IN_RULES[0]]),
        str(tmp_path),
    )
    assert out.count() == 0
    assert jobs.late_rows(query) >= 1


def test_rule_batches_equal_batch(spark, make_events, tmp_path):
    events = mixed(make_events)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    store(events.unionByName(time_sentinel(events)), path,
          START + timedelta(minutes=4), START + timedelta(days=1))
    used = [r for r in rules.BUILT_IN_RULES if r.rule_id != "SCAN_001"]
    rule_batches.run_rule_stream(
        stream(spark, path, events.schema), out, str(tmp_path / "c"), used, delay_seconds=60
    ).awaitTermination()
    want = rules.rule_matches(events, used)
    got = rule_batches.read_rule_stream(spark, out, used)
    assert sorted(got.collect()) == sorted(want.collect())
    assert rule_batches.late_rows(spark, out) == 0


def test_rule_batches_keep_windows_open_and_count_late_rows(spark, make_events, tmp_path):
    brute_only = [rules.BUILT_IN_RULES[0]]
    path, out, seen = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")
    events = make_events(brute(14))

    def run_on():
        rule_batches.run_rule_stream(
            stream(spark, path, events.schema), out, seen, brute_only, delay_seconds=0
        ).awaitTermination()
        return [r.fired_id for r in rule_batches.read_rule_stream(spark, out).collect()]

    assert rule_batches.read_rule_stream(spark, out).count() == 0
    store(events.filter("event_id < 6"), path)
    assert run_on() == []
    store(events.filter("event_id between 6 and 12"), path)
    assert run_on() == [9]
    # Row 3 again is late; row 13 alone must not fire on rows counted before.
    store(events.filter("event_id = 3"), path)
    store(events.filter("event_id = 13"), path)
    assert run_on() == [9]
    assert rule_batches.late_rows(spark, out) == 1


def test_stream_snapshots_close_with_the_watermark(spark, make_events, tmp_path):
    events = make_events(
        [
            {"timestamp": START + timedelta(minutes=10 * i), "source": "network",
             "dest_ip": f"d{i}", "metadata": {"protocol": "tcp", "bytes": "10"}}
            for i in range(12)
        ]
    )
    path = str(tmp_path / "in")
    store(events, path, START + timedelta(minutes=60))
    out, _ = run(spark, jobs.stream_snapshots(stream(spark, path, events.schema)), str(tmp_path))
    assert [(r.window_start, r.unique_dest_ips) for r in out.collect()] == [(START, 6)]


def test_detect_stream(spark, make_events, tmp_path):
    events = mixed(make_events).unionByName(
        make_events(
            [{"event_id": 900, "source": "dns", "event_type": "dns_query",
              "metadata": {"domain": "0123456789abcdef" * 2 + ".c2.example"}}]
        )
    )
    path = str(tmp_path / "in")
    store(events.unionByName(time_sentinel(events)), path, START + timedelta(days=1))
    past = traffic.baseline_stats(traffic.traffic_snapshots(events))
    queries = jobs.detect_stream(
        stream(spark, path, events.schema),
        str(tmp_path / "alerts"),
        str(tmp_path / "checkpoints"),
        traffic_baseline=past,
    )
    for query in queries:
        query.awaitTermination()
    got = jobs.read_stream_alerts(spark, str(tmp_path / "alerts"))
    want = detect(events)
    columns = want.columns
    assert sorted(got.select(*columns).collect()) == sorted(want.collect())


def test_live_feed(spark, make_events, tmp_path):
    events = make_events([{"timestamp": START + timedelta(minutes=i)} for i in range(30)])
    path, feed = str(tmp_path / "in"), str(tmp_path / "feed")
    store(events, path, START + timedelta(minutes=10), START + timedelta(minutes=20))
    jobs.stream_live_feed(
        stream(spark, path, events.schema), feed, str(tmp_path / "checkpoint"), n=12
    ).awaitTermination()
    newest = jobs.read_live_feed(spark, feed)
    assert sorted(r.event_id for r in newest.collect()) == list(range(18, 30))


def test_repeated_delivery(spark, make_events, tmp_path):
    events = make_events(brute(5))
    path = str(tmp_path / "in")
    store(events, path)
    store(events, path)
    sent = stream(spark, path, events.schema).withColumn("delivery", F.concat(F.lit("d"), "event_id"))
    out, _ = run(spark, jobs.drop_repeats(sent, "delivery"), str(tmp_path))
    assert out.count() == 5
    with pytest.raises(ValueError):
        jobs.drop_repeats(events, "event_id")


def test_rule_stream_counts_equal_rows(spark, make_events, tmp_path):
    """Rows of one time and id are rows of their own: what a firing left over counts in the next batch."""
    at = datetime(2026, 4, 9, 12)
    rule = rules.Rule("R", "r", "event_type = 'ssh_failed'", "source_ip", "high", "none", 60, 3)
    equal = [{"event_id": 7, "timestamp": at, "source_ip": "10.0.0.1"}] * 4
    later = [{"event_id": 8 + i, "timestamp": at + timedelta(seconds=10 + i), "source_ip": "10.0.0.1"} for i in range(2)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    everything = make_events([*equal, *later])
    for rows in (equal, later):
        make_events(rows).coalesce(1).write.mode("append").parquet(path)
        streamed = spark.readStream.schema(everything.schema).parquet(path)
        rule_batches.run_rule_stream(streamed, out, str(tmp_path / "check"), [rule], delay_seconds=0).awaitTermination()
    assert rules.rule_matches(everything, [rule]).count() == 2
    assert rule_batches.read_rule_stream(spark, out, [rule]).count() == 2


def test_log_stream_starts_after(spark, tmp_path):
    line = "Apr  9 08:15:30 box sshd[7]: Failed password for a from 192.0.2.{} port 5\n"
    folder = tmp_path / "logs"
    folder.mkdir()
    old, new = folder / "auth.log.1", folder / "auth.log.2"
    old.write_text(line.format(1))
    os.utime(old, (1_700_000_000, 1_700_000_000))
    new.write_text(line.format(2) + "\n junk\n")
    started = datetime(2025, 1, 1)
    lines = logs.stream_logs(spark, str(folder), start_after=started)
    events, rejected = split_parsed(parse_auth(lines, datetime(2026, 4, 10)))
    query = tables.stream_events(events, str(tmp_path / "t"), str(tmp_path / "c"))
    query.awaitTermination()
    stored = tables.read_events(spark, str(tmp_path / "t")).collect()
    assert [(r.source_ip, str(r.event_date)) for r in stored] == [("192.0.2.2", "2026-04-09")]


@pytest.mark.parametrize("empty", [True, False])
def test_route_needs_a_source(spark, empty):
    if empty:
        with pytest.raises(ValueError):
            logs.route_sources({})
    else:
        a = spark.createDataFrame([(1,)], "x int")
        b = spark.createDataFrame([(2, 3)], "x int, y int")
        assert logs.route_sources({"a": a, "b": b}).count() == 2


def test_continuous_intake_equals_batch(spark, tmp_path):
    line = "Apr  9 08:15:30 box sshd[7]: Failed password for a from 192.0.2.{} port 5"
    folder = tmp_path / "auth"
    folder.mkdir()
    streams = {"auth": logs.stream_logs(spark, str(folder), max_files_per_trigger=1)}
    table, check = str(tmp_path / "table"), str(tmp_path / "check")
    for k in range(3):
        (folder / f"auth.{k}").write_text("\n".join([line.format(k), line.format(k), "junk", ""]))
        if k != 1:
            for intake in store_log_streams(streams, table, check, datetime(2026, 5, 1)):
                intake.awaitTermination()
    events, rejects = stored_logs(spark, table)
    assert (events.count(), rejects.count()) == (6, 3)
    assert sorted({r.source_ip for r in events.collect()}) == ["192.0.2.0", "192.0.2.1", "192.0.2.2"]
    batch = tmp_path / "batch"
    store_logs({"auth": logs.read_logs(spark, str(folder))}, str(batch), datetime(2026, 5, 1))
    assert sorted(r.event_id for r in stored_logs(spark, str(batch))[0].collect()) == sorted(r.event_id for r in events.collect())


def test_new_checkpoint_replaces_no_stored_event(spark, tmp_path):
    line = "Apr  9 08:15:30 box sshd[7]: Failed password for a from 192.0.2.{} port 5"
    table = str(tmp_path / "table")
    for k, count in enumerate((3, 2)):
        folder = tmp_path / f"auth{k}"
        folder.mkdir()
        (folder / "log").write_text("\n".join(line.format(10 * k + i) for i in range(count)))
        streams = {"auth": logs.stream_logs(spark, str(folder))}
        for _ in range(2):
            for intake in store_log_streams(streams, table, str(tmp_path / f"check{k}"), datetime(2026, 5, 1)):
                intake.awaitTermination()
    assert stored_logs(spark, table)[0].count() == 5


def test_feed_before_the_first_batch(spark, tmp_path):
    assert jobs.read_live_feed(spark, str(tmp_path / "feed")).count() == 0


def waves(make_events, rows, spark, tmp_path):
    """Rows stored in several files, as their waves arrive, with a last one that moves the watermark on."""
    path = str(tmp_path / "in")
    for wave in rows:
        make_events(wave).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return stream(spark, path, make_events([{}]).schema)


def end():
    return [{"event_id": -1, "timestamp": START + timedelta(days=3), "event_type": "clock", "source_ip": "clock"}]


def test_sudo_sequence_on_a_stream(spark, make_events, tmp_path):
    def event(i, seconds, kind, user="u"):
        return {"event_id": i, "timestamp": START + timedelta(seconds=seconds), "event_type": kind, "metadata": {"username": user}}

    first = [event(1, 0, "sudo_failed"), event(2, 100, "sudo_failed"), event(3, 100, "sudo_command"), event(4, 280, "sudo_command")]
    first += [event(5, 281, "sudo_command"), event(6, 10, "sudo_command", "other"), event(7, 50, "sudo_failed", "other")]
    # Out of order, but inside the delay; then one that is too late.
    second = [event(8, 5000, "sudo_command"), event(9, 4900, "sudo_failed"), event(10, 4950, "sudo_failed")]
    late = [event(11, 60, "sudo_command"), event(12, 9000, "sudo_failed"), event(13, 9000, "sudo_command"), event(14, 9180, "sudo_command")]
    args = (F.col("event_type") == "sudo_failed", F.col("event_type") == "sudo_command", metadata_get("username"))
    streamed = waves(make_events, [first, second, end()], spark, tmp_path)
    out, _ = run(spark, stream_followed_by(streamed, *args, columns=["event_id", "timestamp"]), str(tmp_path))
    want = sequences.followed_by(make_events(first + second), *args, columns=["event_id", "timestamp"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(*out.columns).collect()))
    assert sorted(r.event_id for r in out.collect()) == [3, 4, 8]
    (tmp_path / "again").mkdir()
    # A row is late when the watermark of the micro-batch before had passed it.
    tick = [event(15, 5001, "tick")]
    streamed = waves(make_events, [first, second, tick, late, end()], spark, tmp_path / "again")
    out, query = run(spark, stream_followed_by(streamed, *args), str(tmp_path / "again"))
    assert sorted(r.event_id for r in out.collect()) == [3, 4, 8, 13, 14] and jobs.late_rows(query) >= 1


def test_sudo_sequence_looks_up_a_slice_of_a_key(spark, make_events, tmp_path):
    kinds = ("sudo_failed", "sudo_command", "tick")
    rows = [
        {"event_id": i, "timestamp": START + timedelta(seconds=90 * i), "event_type": kinds[i % 3], "metadata": {"username": "u"}}
        for i in range(600)
    ]
    # Next to the ends of slices: as far apart as allowed, at one time, and a tick too far.
    edge = START.replace(hour=0) + timedelta(days=2)
    for n, (gap, micros) in enumerate([(0, 0), (180, 0), (180, 1), (1, 0)]):
        for k, at in enumerate(edge + timedelta(hours=n, minutes=12 * j) for j in range(4)):
            rows.append({"event_id": 1000 + 10 * n + k, "timestamp": at - timedelta(seconds=gap, microseconds=micros), "event_type": kinds[0], "metadata": {"username": f"v{n}"}})
            rows.append({"event_id": 2000 + 10 * n + k, "timestamp": at, "event_type": kinds[1], "metadata": {"username": f"v{n}"}})
    args = (F.col("event_type") == "sudo_failed", F.col("event_type") == "sudo_command", metadata_get("username"))
    streamed = waves(make_events, [rows, [{**end()[0], "timestamp": START + timedelta(days=9)}]], spark, tmp_path)
    out, _ = run(spark, stream_followed_by(streamed, *args, columns=["event_id", "timestamp"], salts=1), str(tmp_path))
    want = sequences.followed_by(make_events(rows), *args, columns=["event_id", "timestamp"])
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.select(*out.columns).collect()))
    assert out.count() == 200 + 3 * 4
    # The first micro-batch has all rows of the key; what shares its place in the state is a few of them.
    for side in ("left", "right"):
        state = spark.read.format("statestore").option("operatorId", 1).option("joinSide", side).option("batchId", 0).load(f"{tmp_path}/checkpoint")
        assert state.count() >= 200 and state.groupBy("key").count().agg(F.max("count")).first()[0] <= 16


def test_distinct_items_on_a_stream(spark, make_events, tmp_path):
    rng = random.Random(3)
    rows = [
        {"event_id": i, "timestamp": START + timedelta(seconds=i + rng.randint(-40, 40)), "source": "network",
         "source_ip": rng.choice("aaab"), "dest_port": rng.randint(1, 30)}
        for i in range(400)
    ]
    key, item = F.col("source_ip"), F.col("dest_port")
    streamed = waves(make_events, [rows[:150], rows[150:300], rows[300:], end()], spark, tmp_path)
    out = str(tmp_path / "out")
    sliding.run_distinct_stream(streamed, out, str(tmp_path / "check"), key, item, 30, 8, delay_seconds=100).awaitTermination()
    got = sliding.read_sliding_stream(spark, out, sliding.DISTINCT)
    want = sequences.distinct_in_window(make_events(rows), key, item, 30, 8)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert got.count() > 50
    # One window of rows is kept, and old folders are gone.
    kept = sorted(p.name for p in (tmp_path / "out").glob("rows/run=*/*"))
    assert kept == ["batch=2", "batch=3"]
    assert spark.read.parquet(str(next((tmp_path / "out").glob("rows/run=*/batch=2")))).count() < 250
    assert sliding.read_sliding_stream(spark, str(tmp_path / "none"), sliding.DISTINCT).count() == 0


def test_deviation_on_a_stream(spark, make_events, tmp_path):
    rng = random.Random(4)
    rows = [
        {"event_id": h, "timestamp": START + timedelta(minutes=60 * h + 7), "source_ip": f"h{h % 2}",
         "metadata": {"bytes": str(1e9 + (5000 if h % 17 == 0 else rng.randint(0, 900)))}}
        for h in range(160)
    ]
    host, amount = F.col("source_ip"), metadata_get("bytes", None).cast("double")
    last = [{"event_id": -1, "timestamp": START + timedelta(days=30), "source_ip": "clock"}]
    streamed = waves(make_events, [rows[:60], rows[60:100], rows[100:], last], spark, tmp_path)
    out = str(tmp_path / "out")
    sliding.run_deviation_stream(
        streamed, out, str(tmp_path / "check"), host, amount, history=25, min_samples=10
    ).awaitTermination()
    got = sliding.read_sliding_stream(spark, out, sliding.DEVIATION)
    want = sequences.deviation_from_baseline(make_events(rows), host, amount, history=25, min_samples=10)
    rounded = [F.round(c, 3).alias(c) if c in ("mean", "std") else F.col(c) for c in got.columns]
    assert sorted(map(tuple, got.select(*rounded).collect())) == sorted(map(tuple, want.select(*rounded).collect()))
    assert got.count() >= 4
