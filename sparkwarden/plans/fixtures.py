"""Security events derived from the generic ``events`` table.

The column expressions are SQL that Spark and DuckDB both read; the three
spellings that differ are placeholders.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The day after the last event.
AS_OF = datetime(2024, 1, 31)

SPARK = {
    "K": "cast(get_json_object(props,'$.k') as int)",
    "D256": "user_id div 256",
    "TS": "date_format(ts,'MMM d HH:mm:ss')",
}
DUCKDB = {
    "K": "cast(json_extract_string(props,'$.k') as int)",
    "D256": "user_id // 256",
    "TS": "strftime(ts,'%b %-d %H:%M:%S')",
}

BASE = [
    "event_id",
    "cast(ts as timestamp) as ts",
    "user_id",
    "event_type as et",
    "value",
    "{K} as k",
    "user_id % 3 as u",
]

_HEAD = "concat({TS}, ' host', cast(u as string), "
_PEER = "' from 10.0.0.', cast(user_id % 256 as string), ' port ', cast(40000 + k as string)"
_SSHD = _HEAD + "' sshd[', cast(1000 + k as string), ']: "
_USER = "cast(user_id % 7 as string)"

EVENTS = [
    "event_id",
    "ts as timestamp",
    """case when et in ('error','signup') then 'auth' when et='purchase' and k%2=0 then 'auth'
        when et='purchase' then 'syslog' when et='click' then 'network' else 'dns' end as source""",
    """case et when 'error' then 'ssh_failed' when 'signup' then 'ssh_success'
        when 'click' then 'connection_attempt' when 'view' then 'dns_query'
        else case when k%2=0 then 'sudo_command' else 'syslog_CRON' end end as event_type""",
    """case when et='error' then case when k>=95 then 'critical' when k>=85 then 'high'
          else 'medium' end
        when et='click' or (et='purchase' and k%2=0) then 'low' else 'info' end as severity""",
    """case when et='purchase' then null
        when user_id%10=0
          then concat('45.33.', cast({D256} as string), '.', cast(user_id%256 as string))
        else concat('10.0.', cast({D256} as string), '.', cast(user_id%256 as string))
        end as source_ip""",
    "case when et='click' then concat('192.168.1.', cast(k%16 as string)) end as dest_ip",
    """cast(case when et in ('error','signup') then 22 when et='click' then 1+k*10
        when et='view' then 53 end as int) as dest_port""",
    f"case when et in ('error','signup','purchase') then concat('user', {_USER}) end as username",
    "case when et='click' then case when k%4=0 then 'udp' else 'tcp' end end as protocol",
    "case when et='click' then value*1000 end as bytes",
    """case when et='view' then case
        when k%5=0 then concat(substr(md5(cast(event_id as string)), 1, 10+k%23), '.c2.example.net')
        when k%5=1
          then concat(upper(substr(md5(cast(event_id as string)), 1, 22)), '.example.org')
        else concat('www.site', cast(k as string), '.example.com') end end as domain""",
    f"""case
        when et='error' and k%10=9
          then {_SSHD}maximum authentication attempts exceeded for user', {_USER}, {_PEER}, ' ssh2')
        when et='error'
          then {_SSHD}Failed password for ',
            case when k%3=0 then 'invalid user ' else '' end, 'user', {_USER}, {_PEER}, ' ssh2')
        when et='signup' and k%4=0 then {_SSHD}Invalid user user', {_USER}, {_PEER})
        when et='signup'
          then {_SSHD}Accepted ', case when k%2=0 then 'password' else 'publickey' end,
            ' for user', {_USER}, {_PEER}, ' ssh2')
        when et='purchase' and k%2=0
          then {_HEAD}' sudo: user', {_USER},
            ' : TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/usr/bin/job ', cast(k as string))
        when et='purchase'
          then {_HEAD}' CRON[', cast(1000 + k as string), ']: (root) ',
            case when k%10=1 then 'critical error' when k%10=3 then 'Kernel panic'
              when k%10=5 then 'Out of memory: Killed process' when k%10=7 then 'failover done'
              else 'CMD (job)' end)
        when et='view' and k%7=0 then 'unparseable line'
        else {_HEAD}' app[', cast(k as string), ']: ', et, ' ok') end as line""",
]

# 30 days become 3 minutes, and seven sources share all events.
BURST_US = 1704067200000000
BURST_FACTOR = 14400
BURST_SOURCE = "concat('10.1.0.', cast(user_id % 7 as string)) as source_ip"


def _filled(exprs: list[str], dialect: dict[str, str]) -> list[str]:
    out = []
    for e in exprs:
        for name, text in dialect.items():
            e = e.replace("{" + name + "}", text)
        out.append(e)
    return out


def derive_events(raw: DataFrame, burst: bool = False) -> DataFrame:
    """Event table from rows of the generic table, batch or stream.

    With ``burst`` seven sources share all events and 30 days become 3 minutes.
    """
    exprs = [
        BURST_SOURCE if burst and e.endswith("as source_ip") else e
        for e in _filled(EVENTS, SPARK)
    ]
    typed = raw.selectExpr(*_filled(BASE, SPARK)).selectExpr(*exprs)
    if burst:
        squeezed = f"{BURST_US} + (unix_micros(timestamp) - {BURST_US}) div {BURST_FACTOR}"
        typed = typed.withColumn("timestamp", F.timestamp_micros(F.expr(squeezed)))
    entries = F.create_map(
        *[
            x
            for c in ("username", "protocol", "bytes", "domain")
            for x in (F.lit(c), F.col(c).cast("string"))
        ]
    )
    return typed.select(
        "event_id",
        "timestamp",
        "source",
        "event_type",
        "severity",
        "source_ip",
        "dest_ip",
        "dest_port",
        F.col("line").alias("raw_message"),
        F.lit(0.0).alias("anomaly_score"),
        F.map_filter(entries, lambda _, v: v.isNotNull()).alias("metadata"),
    )


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def sec_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_events(raw_events(spark, sf_dir))


def sec_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive_events(raw_events(spark, sf_dir), burst=True)


def stream_events(spark: SparkSession, sf_dir: str, burst: bool = False) -> DataFrame:
    """The same events read as a stream of the table's files.

    The path is a glob, as a stream takes a single file in no other way.
    """
    schema = raw_events(spark, sf_dir).schema
    raw = spark.readStream.schema(schema).parquet(f"{sf_dir}/{{events}}.parquet")
    return derive_events(raw, burst)


def sec_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sec_events(spark, sf_dir).select("event_id", F.col("raw_message").alias("value"))


def sudo_lines(events: DataFrame) -> DataFrame:
    """The log lines of events; those of CRON jobs with an odd id are failed sudo passwords instead. Batch or stream."""
    failed = F.concat(
        F.date_format("timestamp", "MMM d HH:mm:ss"),
        F.lit(" host1 sudo[77]: pam_unix(sudo:auth): authentication failure; logname= uid=0 user="),
        F.element_at("metadata", "username"),
    )
    planted = (F.col("event_type") == "syslog_CRON") & (F.col("event_id") % 2 == 1)
    return events.select("event_id", F.when(planted, failed).otherwise(F.col("raw_message")).alias("value"))


def sec_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.expr("cast((event_id * 37) % 101 as double) / 100")
    return sec_events(spark, sf_dir).withColumn("anomaly_score", score)


def sec_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An alert per severe failed login; narratives partly missing or empty."""
    severe = sec_events(spark, sf_dir).filter(
        "event_type = 'ssh_failed' and severity in ('high', 'critical')"
    )
    return severe.select(
        F.col("event_id").alias("alert_id"),
        F.to_json(F.array(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS"))).alias(
            "event_cluster"
        ),
        "severity",
        F.expr(
            "case when event_id % 11 = 0 then null when event_id % 11 = 1 then '' "
            "else concat('Alert ', raw_message) end"
        ).alias("narrative"),
        F.lit(0).alias("acknowledged"),
        F.col("timestamp").alias("created_at"),
    )


def sec_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third alert, and one id that no alert has."""
    known = sec_alerts(spark, sf_dir).filter("alert_id % 3 = 0").select("alert_id")
    unknown = raw_events(spark, sf_dir).agg((F.min("event_id") - 1).alias("alert_id"))
    return known.unionByName(unknown)


def sec_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with planted faults."""
    return sec_events(spark, sf_dir).withColumns(
        {
            "severity": F.expr("if(event_id % 50 = 0, 'extreme', severity)"),
            "source": F.expr("if(event_id % 50 = 1, 'web', source)"),
            "dest_port": F.expr("if(event_id % 50 = 2, 70000, dest_port)"),
            "raw_message": F.expr("if(event_id % 50 = 3, null, raw_message)"),
        }
    )


def duckdb_views() -> dict[str, str]:
    """The same views for DuckDB, as bodies of common table expressions."""
    burst = [
        BURST_SOURCE if e.endswith("as source_ip") else e for e in _filled(EVENTS, DUCKDB)
    ]
    return {
        "sec_base": f"select {', '.join(_filled(BASE, DUCKDB))} from events",
        "sec_events": f"select {', '.join(_filled(EVENTS, DUCKDB))} from sec_base",
        "sec_typed_burst": f"select {', '.join(burst)} from sec_base",
        "sec_burst": (
            "select * replace (make_timestamp(us) as timestamp) from (select *, "
            f"{BURST_US} + (epoch_us(timestamp) - {BURST_US}) // {BURST_FACTOR} as us "
            "from sec_typed_burst)"
        ),
        "sec_lines": "select event_id, line as value from sec_events",
        "sec_scored": (
            "select *, cast((event_id * 37) % 101 as double) / 100 as anomaly_score "
            "from sec_events"
        ),
        "sec_alerts": (
            "select event_id as alert_id, "
            "strftime(timestamp, '%Y-%m-%d %H:%M:%S.%f') as event_time, severity, "
            "case when event_id % 11 = 0 then null when event_id % 11 = 1 then '' "
            "else concat('Alert ', line) end as narrative, 0 as acknowledged, "
            "timestamp as created_at from sec_events "
            "where event_type = 'ssh_failed' and severity in ('high', 'critical')"
        ),
        "sec_acks": (
            "select alert_id from sec_alerts where alert_id % 3 = 0 "
            "union all select min(event_id) - 1 from events"
        ),
        "sec_invalid": (
            "select * replace (if(event_id % 50 = 0, 'extreme', severity) as severity, "
            "if(event_id % 50 = 1, 'web', source) as source, "
            "if(event_id % 50 = 2, 70000, dest_port) as dest_port, "
            "if(event_id % 50 = 3, null, line) as line) from sec_events"
        ),
    }


def time_sentinel(events: DataFrame, after: str = "1 day") -> DataFrame:
    """One network event, in no group with others, later than all of ``events``.

    Read along with the stream it moves the watermark past every real row, so a
    replay of stored events ends with nothing pending.
    """
    return events.agg(F.max("timestamp").alias("last")).select(
        F.lit(-1).cast("bigint").alias("event_id"),
        (F.col("last") + F.expr(f"INTERVAL {after}")).alias("timestamp"),
        F.lit("network").alias("source"),
        F.lit("clock").alias("event_type"),
        F.lit("info").alias("severity"),
        F.lit("clock").alias("source_ip"),
        F.lit(None).cast("string").alias("dest_ip"),
        F.lit(None).cast("int").alias("dest_port"),
        F.lit("").alias("raw_message"),
        F.lit(0.0).alias("anomaly_score"),
        F.lit(None).cast("map<string,string>").alias("metadata"),
    )
