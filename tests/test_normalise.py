from __future__ import annotations

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions.severity import severity_rank
from sparkwarden.functions.timestamps import iso_text, syslog_timestamp
from sparkwarden.operators import sequences
from sparkwarden.operators.normalise import (
    metadata_get,
    parse_auth,
    parse_syslog,
    split_parsed,
    validate_events,
)
from sparkwarden.plans.detect import normalise_logs, store_logs, stored_logs
from sparkwarden.sources import logs, tables

NOW = datetime(2026, 4, 10)
BOX = "Apr  9 08:15:30 box"


def parsed(spark, parser, *lines, **kw):
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    events, rejected = split_parsed(parser(df, NOW, **kw))
    return events.collect(), rejected.collect()


@pytest.mark.parametrize(
    ("line", "kind", "severity", "ip", "port", "metadata"),
    [
        (
            f"{BOX} sshd[7]: Failed password for alice from 192.0.2.7 port 50100 ssh2",
            "ssh_failed", "medium", "192.0.2.7", 22, {"username": "alice", "port": "50100"},
        ),
        (
            f"{BOX} sshd[7]: Failed password for invalid user bob from 192.0.2.8 port 1 ssh2",
            "ssh_failed", "medium", "192.0.2.8", 22, {"username": "bob", "port": "1"},
        ),
        (
            f"{BOX} sshd[8]: Accepted publickey for carol from 10.1.1.1 port 22 ssh2",
            "ssh_success", "info", "10.1.1.1", 22, {"username": "carol", "port": "22"},
        ),
        (
            f"{BOX} sshd[8]: Accepted password for dave from 10.1.1.2 port 4 ssh2",
            "ssh_success", "info", "10.1.1.2", 22, {"username": "dave", "port": "4"},
        ),
        (
            f"{BOX} sshd[9]: Invalid user erin from 198.51.100.4 port 999",
            "ssh_invalid_user", "medium", "198.51.100.4", 22, {"username": "erin", "port": "999"},
        ),
        (
            f"{BOX} sudo: frank : TTY=pts/1 ; PWD=/ ; USER=root ; COMMAND=/bin/ls -l  ",
            "sudo_command", "low", None, None, {"username": "frank", "command": "/bin/ls -l"},
        ),
        (
            f"{BOX} sshd[9]: maximum authentication attempts exceeded for gail "
            "from 198.51.100.5 port 6 ssh2",
            "ssh_brute_force", "high", "198.51.100.5", 22, {"username": "gail"},
        ),
    ],
)
def test_auth_formats(spark, line, kind, severity, ip, port, metadata):
    (event,), rejected = parsed(spark, parse_auth, line)
    assert rejected == []
    assert event.timestamp == datetime(2026, 4, 9, 8, 15, 30)
    assert (event.source, event.event_type, event.severity) == ("auth", kind, severity)
    assert (event.source_ip, event.dest_port, event.metadata) == (ip, port, metadata)


def test_auth_search_is_unanchored_and_ordered(spark):
    both = (
        f"relay> {BOX} sshd[1]: Invalid user x from 1.1.1.1 port 2 "
        f"{BOX} sshd[1]: Failed password for y from 2.2.2.2 port 3"
    )
    (event,), _ = parsed(spark, parse_auth, both)
    assert (event.event_type, event.source_ip) == ("ssh_failed", "2.2.2.2")


def test_unmatched_and_impossible_dates_are_rejected(spark):
    bad_day = "Feb 30 08:15:30 box sshd[7]: Failed password for a from 1.1.1.1 port 5"
    events, rejected = parsed(spark, parse_auth, "nothing of interest", bad_day)
    assert events == []
    assert {r.reject_reason for r in rejected} == {"no_match", "bad_timestamp"}


@pytest.mark.parametrize(
    ("message", "severity"),
    [
        ("CRON[44]: (root) CMD (backup)", "info"),
        ("kernel[0]: segfault at 0 ip 0", "high"),
        ("kernel[0]: Out of memory: Killed process 4", "high"),
        ("kernel: Kernel panic - not syncing", "critical"),
        ("app: critical error", "medium"),
        ("app: failover done", "medium"),
    ],
)
def test_syslog(spark, message, severity):
    (event,), _ = parsed(spark, parse_syslog, f"{BOX} {message}")
    process = message.split("[")[0].split(":")[0]
    assert event.event_type == f"syslog_{process}"
    assert event.severity == severity
    assert event.metadata == {"hostname": "box", "process": process}


def test_syslog_is_anchored(spark):
    events, rejected = parsed(spark, parse_syslog, f"> {BOX} app: hello", "", "junk")
    assert events == [] and len(rejected) == 3


def test_year_and_rollover(spark):
    df = spark.createDataFrame([("Dec 31 23:59:59",), ("Jan  2 00:00:00",)], "t string")

    def years(**kw):
        ts = syslog_timestamp(F.col("t"), datetime(2026, 1, 3), **kw)
        return [r[0] for r in df.select(F.year(ts)).collect()]

    assert years() == [2026, 2026]
    assert years(rollover=True) == [2025, 2026]


def test_iso_text_leaves_out_zero_fraction(spark):
    df = spark.createDataFrame(
        [(datetime(2026, 1, 2, 3, 4, 5),), (datetime(2026, 1, 2, 3, 4, 5, 60),)], "t timestamp"
    )
    got = [r[0] for r in df.select(iso_text(F.col("t"))).collect()]
    assert got == ["2026-01-02T03:04:05", "2026-01-02T03:04:05.000060"]


def test_constraints_let_null_pass(make_events):
    valid, invalid = validate_events(
        make_events(
            [
                {},
                {"severity": "extreme", "source": "web"},
                {"dest_port": 65536},
                {"anomaly_score": 1.5},
                {"raw_message": None},
            ]
        )
    )
    assert [r.event_id for r in valid.collect()] == [0]
    broken = {r.event_id: list(r.violations) for r in invalid.collect()}
    assert broken == {
        1: ["source_value", "severity_value"],
        2: ["dest_port_range"],
        3: ["anomaly_score_range"],
        4: ["raw_message_null"],
    }


def test_severity_rank(spark):
    df = spark.createDataFrame([("info",), ("critical",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(severity_rank(F.col("s"))).collect()] == [0, 4, None, None]


def test_read_logs_strips_and_skips(spark, tmp_path):
    (tmp_path / "auth.log").write_bytes(b"  one\t\r\n\n \x1f\ntwo \xff\n")
    rows = sorted(r.value for r in logs.read_logs(spark, str(tmp_path)).collect())
    assert rows == ["one", "two �"]


def test_sources_route_to_their_parsers(spark, tmp_path):
    auth, syslog = tmp_path / "auth.log", tmp_path / "syslog"
    auth.write_text(f"{BOX} sshd[7]: Failed password for a from 1.1.1.1 port 5\njunk\n")
    syslog.write_text(f"{BOX} app: hello\n")
    found = logs.read_existing(
        spark, {"auth": str(auth), "syslog": str(syslog), "other": str(tmp_path / "none")}
    )
    assert set(found) == {"auth", "syslog"}
    events, rejects = normalise_logs(found, NOW)
    assert {(e.source, e.event_type) for e in events.collect()} == {
        ("auth", "ssh_failed"),
        ("syslog", "syslog_app"),
    }
    assert [r.reject_reason for r in rejects.collect()] == ["no_match"]
    store_logs(found, str(tmp_path / "table"), NOW)
    stored, kept_back = stored_logs(spark, str(tmp_path / "table"))
    assert sorted(stored.drop("event_date").collect()) == sorted(events.collect())
    assert kept_back.collect() == rejects.collect()


def test_events_survive_the_table(spark, make_events, tmp_path):
    rows = [
        {"timestamp": datetime(2026, 4, d, 1), "metadata": {"username": "a"}} for d in (1, 2, 3)
    ]
    events = make_events(rows)
    tables.write_events(events, str(tmp_path / "t"))
    back = tables.read_events(spark, str(tmp_path / "t")).select(*events.columns)
    assert sorted(back.collect()) == sorted(events.collect())
    assert sorted(p.name for p in (tmp_path / "t").glob("event_date=*")) == [
        "event_date=2026-04-01",
        "event_date=2026-04-02",
        "event_date=2026-04-03",
    ]


def test_metadata_stored_as_text_is_decoded(spark, make_events, tmp_path):
    events = make_events([{}]).withColumn("metadata", F.lit('{"port": 5, "username": "a"}'))
    events.write.parquet(str(tmp_path / "t"))
    (row,) = tables.read_events(spark, str(tmp_path / "t")).collect()
    assert row.metadata == {"port": "5", "username": "a"}


def test_wire_json_keeps_nulls(make_events):
    (row,) = tables.to_wire_json(make_events([{"metadata": {"k": "v"}}])).collect()
    body = json.loads(row.value)
    assert body["timestamp"] == "2026-04-09T12:00:00"
    assert body["dest_ip"] is None and body["metadata"] == {"k": "v"}
    assert list(body) == [
        "timestamp", "source", "event_type", "severity", "raw_message",
        "source_ip", "dest_ip", "dest_port", "metadata",
    ]


@pytest.mark.parametrize("end", ["\u2028", "\u2029", "\u0085", "\r"])
def test_other_line_ends_stand_inside_messages(spark, end):
    head = "Apr  9 08:15:30 box "
    lines = spark.createDataFrame([(f"{head}sudo: root : TTY=x{end} ; COMMAND=/bin/ls{end}-l",)], "value string")
    auth = parse_auth(lines, datetime(2026, 5, 1)).first()
    assert auth.event_type == "sudo_command" and auth.metadata["command"] == f"/bin/ls{end}-l"
    lines = spark.createDataFrame([(f"{head}app[1]: first{end}then an error",)], "value string")
    assert parse_syslog(lines, datetime(2026, 5, 1)).first().severity == "medium"


def test_own_parser(spark):
    def parse_words(lines, reference_ts, rollover=False):
        return parse_syslog(lines.withColumn("value", F.concat(F.lit("Apr  9 08:15:30 h words: "), "value")), reference_ts, rollover)

    lines = {"syslog": spark.createDataFrame([("hello",)], "value string")}
    events, rejects = normalise_logs(lines, datetime(2026, 5, 1), parsers={"syslog": parse_words})
    assert events.first().event_type == "syslog_words" and rejects.count() == 0


def test_sudo_failure_then_command(spark):
    lines = [
        "Apr  9 08:15:30 box sudo: pam_unix(sudo:auth): authentication failure; logname=ann uid=1000 euid=0 tty=/dev/pts/0 ruser=ann rhost=  user=ann",
        "Apr  9 08:16:30 box sudo: ann : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls",
        "Apr  9 08:16:40 box sudo: bob : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/ls",
    ]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    assert [r.event_type for r in parse_auth(df, NOW).orderBy("raw_message").collect()].count(None) == 1
    events, rejected = split_parsed(parse_auth(df, NOW, sudo_failures=True))
    assert rejected.count() == 0
    found = sequences.followed_by(
        events, F.col("event_type") == "sudo_failed", F.col("event_type") == "sudo_command", metadata_get("username"), 180
    ).collect()
    assert [r.metadata["username"] for r in found] == ["ann"]
