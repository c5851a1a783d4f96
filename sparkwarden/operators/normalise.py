"""Log lines to typed events."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.severity import severity_from_text
from ..functions.text import strip
from ..functions.timestamps import syslog_timestamp
from ..schemas import EVENT_COLUMNS, SEVERITIES, SOURCES

# Fixed log formats. (?U) makes \w, \d and \s cover Unicode. Only \n ends a line: other
# line ends may stand inside a message, where Java's "." would stop.
_TIME = r"(?U)(\w+\s+\d+\s+[\d:]+)\s+"
_SSHD = _TIME + r"\S+\s+sshd\[\d+\]:\s+"
_FROM = r"(\S+) from ([\d.]+)"
SSH_FAILED = _SSHD + r"Failed password for (?:invalid user )?" + _FROM + r" port (\d+)"
SSH_SUCCESS = _SSHD + r"Accepted (?:password|publickey) for " + _FROM + r" port (\d+)"
SSH_INVALID_USER = _SSHD + r"Invalid user " + _FROM + r" port (\d+)"
SUDO_COMMAND = _TIME + r"\S+\s+sudo:\s+(\S+)\s+:[^\n]*COMMAND=([^\n]*)"
SSH_BRUTE_FORCE = (
    _SSHD + r"maximum authentication attempts exceeded for (?:invalid user )?" + _FROM
)
SYSLOG = r"(?U)^(\w+\s+\d+\s+[\d:]+)\s+(\S+)\s+(\S+?)(?:\[\d+\])?:\s+([^\n]*)"

# Fixed: event type, severity, text every such line contains, pattern, in the
# order in which a line is tried. "port" says whether a source port is present.
AUTH_FORMATS = (
    ("ssh_failed", "medium", "Failed password for ", SSH_FAILED, True),
    ("ssh_success", "info", "Accepted ", SSH_SUCCESS, True),
    ("ssh_invalid_user", "medium", "Invalid user ", SSH_INVALID_USER, True),
    ("sudo_command", "low", "COMMAND=", SUDO_COMMAND, False),
    (
        "ssh_brute_force",
        "high",
        "maximum authentication attempts exceeded for ",
        SSH_BRUTE_FORCE,
        False,
    ),
)

# A failed sudo password as PAM logs it; tried after the others, and only if asked for.
SUDO_FAILED = (
    _TIME
    + r"\S+\s+sudo(?:\[\d+\])?:\s+pam_unix\(sudo:auth\): authentication failure;[^\n]*\suser=(\S+)"
)
SUDO_FAILED_FORMAT = ("sudo_failed", "medium", "pam_unix(sudo:auth)", SUDO_FAILED, False)

_PARSED = (
    "struct<time_text:string,event_type:string,severity:string,source_ip:string,"
    "dest_port:int,metadata:map<string,string>>"
)


def _auth_format(line: Column, kind: str, severity: str, pattern: str, has_port: bool) -> Column:
    def group(i: int) -> Column:
        return F.regexp_extract(line, pattern, i)

    if kind == "sudo_command":
        command = strip(group(3))
        ip, port = F.lit(None), F.lit(None)
        metadata = F.create_map(F.lit("username"), group(2), F.lit("command"), command)
    elif kind == "sudo_failed":
        ip, port = F.lit(None), F.lit(None)
        metadata = F.create_map(F.lit("username"), group(2))
    else:
        ip, port = group(3), F.lit(22)
        pairs = [F.lit("username"), group(2)]
        if has_port:
            pairs += [F.lit("port"), group(4)]
        metadata = F.create_map(*pairs)
    parsed = F.struct(
        group(1).alias("time_text"),
        F.lit(kind).alias("event_type"),
        F.lit(severity).alias("severity"),
        ip.alias("source_ip"),
        port.alias("dest_port"),
        metadata.alias("metadata"),
    )
    return parsed.cast(_PARSED)


def _events(
    lines: DataFrame,
    source: str,
    parsed: Column,
    severity: Column,
    reference_ts: datetime,
    rollover: bool,
) -> DataFrame:
    """Event columns from a parsed struct, plus why a line gave no event.

    The struct goes through a generator, one row to one row. Unlike a projection
    it is not merged into filters further up, so a line is matched once.
    """

    df = lines.select("*", F.inline_outer(F.array(parsed)))
    df = df.withColumn(
        "timestamp", syslog_timestamp(F.col("time_text"), reference_ts, rollover)
    )
    if "event_id" not in lines.columns:
        origin = F.col("file_path") if "file_path" in lines.columns else F.lit("")
        df = df.withColumn("event_id", F.xxhash64(origin, "timestamp", "value"))
    return df.select(
        "event_id",
        "timestamp",
        F.lit(source).alias("source"),
        "event_type",
        severity.alias("severity"),
        "source_ip",
        F.lit(None).cast("string").alias("dest_ip"),
        "dest_port",
        F.col("value").alias("raw_message"),
        F.lit(0.0).alias("anomaly_score"),
        "metadata",
        F.when(F.col("event_type").isNull(), "no_match")
        .when(F.col("timestamp").isNull(), "bad_timestamp")
        .alias("reject_reason"),
    )


def parse_auth(
    lines: DataFrame, reference_ts: datetime, rollover: bool = False, sudo_failures: bool = False
) -> DataFrame:
    """Authentication log lines (column ``value``) to events.

    With ``sudo_failures`` failed sudo passwords are events too, so that a failure
    followed by a command can be found (``sequences.followed_by``).

    Formats are searched anywhere in the line and in a fixed order. A cheap
    substring test guards each pattern, so most lines meet one regex only.
    """
    line = F.col("value")
    tried = [
        F.when(
            line.contains(marker) & line.rlike(pattern),
            _auth_format(line, kind, severity, pattern, has_port),
        )
        for kind, severity, marker, pattern, has_port in (
            *AUTH_FORMATS,
            *([SUDO_FAILED_FORMAT] if sudo_failures else []),
        )
    ]
    parsed = F.coalesce(*tried)
    return _events(lines, "auth", parsed, F.col("severity"), reference_ts, rollover)


def parse_syslog(lines: DataFrame, reference_ts: datetime, rollover: bool = False) -> DataFrame:
    """``time host process[pid]: message`` lines to events."""
    line = F.col("value")

    def group(i: int) -> Column:
        return F.regexp_extract(line, SYSLOG, i)

    parsed = F.struct(
        group(1).alias("time_text"),
        F.concat(F.lit("syslog_"), group(3)).alias("event_type"),
        F.lit(None).cast("string").alias("source_ip"),
        F.lit(None).cast("int").alias("dest_port"),
        group(4).alias("message"),
        F.create_map(
            F.lit("hostname"), group(2), F.lit("process"), group(3)
        ).alias("metadata"),
    )
    matched = F.when(line.rlike(SYSLOG), parsed)
    severity = F.when(F.col("event_type").isNotNull(), severity_from_text(F.col("message")))
    return _events(lines, "syslog", matched, severity, reference_ts, rollover)


def split_parsed(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, rejected lines with their reason)."""
    events = parsed.filter(F.col("reject_reason").isNull()).select(*EVENT_COLUMNS)
    rejected = parsed.filter(F.col("reject_reason").isNotNull()).select(
        "event_id", "source", "raw_message", "reject_reason"
    )
    return events, rejected


def metadata_get(key: str, default: str | None = "unknown") -> Column:
    """A metadata entry, or the default when it is missing."""
    value = F.try_element_at(F.col("metadata"), F.lit(key))
    return value if default is None else F.coalesce(value, F.lit(default))


def event_violations() -> Column:
    """Names of the table constraints an event breaks; null passes a CHECK."""

    def broken(condition: Column, name: str) -> Column:
        return F.when(condition, F.lit(name))

    not_null = ("timestamp", "source", "event_type", "severity", "raw_message")
    checks = [broken(F.col(c).isNull(), f"{c}_null") for c in not_null]
    checks += [
        broken(~F.col("source").isin(*SOURCES), "source_value"),
        broken(~F.col("severity").isin(*SEVERITIES), "severity_value"),
        broken(~F.col("dest_port").between(0, 65535), "dest_port_range"),
        broken(~F.col("anomaly_score").between(0.0, 1.0), "anomaly_score_range"),
    ]
    return F.array_compact(F.array(*checks))


def validate_events(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid events, invalid events with their ``violations``)."""
    checked = events.withColumn("violations", event_violations())
    valid = checked.filter(F.size("violations") == 0).drop("violations")
    return valid, checked.filter(F.size("violations") > 0)
