"""Detection rules: keyed windows that fire at a threshold and then start over."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timestamps import iso_text
from ..schemas import ALERT_COLUMNS
from .slices import LOOKBACKS_PER_SLICE, MICROS, home_slice, slice_offsets, slice_window, with_slices

EVIDENCE = 10
RECENT = 100

# Fixed sentence format.
MATCH_SENTENCE = (
    "Rule '%s' triggered: %d matching events from %s within %ds window. "
    "Recommended action: %s"
)


@dataclass(frozen=True)
class Rule:
    """A rule: which events count (SQL), by which key (SQL), how many in how long."""

    rule_id: str
    name: str
    predicate: str
    key: str
    severity: str
    response: str
    window_seconds: int
    threshold: int
    enabled: bool = True

    def __post_init__(self) -> None:
        if self.severity not in ("medium", "high", "critical"):
            raise ValueError(f"{self.rule_id}: invalid severity {self.severity}")
        if self.window_seconds <= 0 or self.threshold <= 0:
            raise ValueError(f"{self.rule_id}: window and threshold must be positive")


BY_SOURCE_IP = "coalesce(nullif(source_ip, ''), 'unknown')"
BY_USERNAME = "coalesce(try_element_at(metadata, 'username'), 'unknown')"
GLOBAL = "'global'"

# Fixed built-in rules.
BUILT_IN_RULES = (
    Rule(
        rule_id="BRUTE_001",
        name="SSH Brute Force",
        predicate="event_type in ('ssh_failed', 'ssh_brute_force')",
        key=BY_SOURCE_IP,
        severity="high",
        response="flag + auto-block suggestion",
        window_seconds=300,
        threshold=10,
    ),
    Rule(
        rule_id="PRIV_001",
        name="Privilege Escalation Attempt",
        predicate="event_type = 'sudo_command'",
        key=BY_USERNAME,
        severity="critical",
        response="immediate alert",
        window_seconds=120,
        threshold=1,
    ),
    Rule(
        rule_id="SCAN_001",
        name="Port Scan Detection",
        predicate="source = 'network'",
        key=BY_SOURCE_IP,
        severity="medium",
        response="flag + network context",
        window_seconds=60,
        threshold=50,
    ),
    Rule(
        rule_id="EXFIL_001",
        name="Data Exfiltration Indicator",
        predicate="source = 'network'",
        key=BY_SOURCE_IP,
        severity="high",
        response="alert + traffic breakdown",
        window_seconds=600,
        threshold=3,
    ),
)


def check_rules(rules: Sequence[Rule]) -> list[Rule]:
    """The enabled rules; ids must be unique."""
    ids = [r.rule_id for r in rules]
    if len(set(ids)) != len(ids):
        raise ValueError("rule ids must be unique")
    return [r for r in rules if r.enabled]


def rules_table(spark: SparkSession, rules: Sequence[Rule] = BUILT_IN_RULES) -> DataFrame:
    rows = [
        (r.rule_id, r.name, r.predicate, r.key, r.severity, r.response)
        + (r.window_seconds, r.threshold, r.enabled)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, name string, predicate string, key string, severity string, "
        "response string, window_seconds int, threshold int, enabled boolean",
    )


def load_rules(table: DataFrame) -> list[Rule]:
    """Rules kept as a table, for example edited by a user; the table is small by nature."""
    return [Rule(**row.asDict()) for row in table.collect()]


def rule_hits(rules: Sequence[Rule] = BUILT_IN_RULES) -> Column:
    """The (rule_id, group_key) of every rule an event counts for; none for an event without a time."""
    hits = [
        F.when(
            F.expr(r.predicate) & F.col("timestamp").isNotNull(),
            F.struct(F.lit(r.rule_id).alias("rule_id"), F.expr(r.key).alias("group_key")),
        )
        for r in check_rules(rules)
    ]
    return F.array_compact(F.array(*hits))


def match_rules(events: DataFrame, rules: Sequence[Rule] = BUILT_IN_RULES) -> DataFrame:
    """(rule_id, group_key, event) for every rule an event counts for; no shuffle.

    The time takes part in the test, so that on a stream it is made after the
    watermark has seen the event, whatever the rules are.
    """
    return events.withColumn("_hit", F.explode(rule_hits(rules))).select("*", "_hit.rule_id", "_hit.group_key").drop("_hit")


# Slices whose maps one row holds while a chain is followed: a longer chain is folded block by block.
CHAIN_BLOCK = 512


def _may_fire_from(runs: str, start: str, threshold: int) -> str:
    """SQL for the row number from which a key may fire again after these runs, if it may from ``start`` on."""
    first = "greatest(run.lo, free)"
    return (
        f"aggregate({runs}, {start}, (free, run) -> if({first} <= run.hi, "
        f"{first} + ((run.hi - {first}) div {threshold}) * {threshold} + {threshold}, free))"
    )


def _after(maps: str, start: str) -> str:
    return f"aggregate({maps}, {start}, (free, step) -> element_at(step.after, cast(free as int)))"


def _entered(slices: DataFrame, totals: DataFrame, threshold: int) -> DataFrame:
    """Adds ``free``: the row of the slice (from 1) from which its key may fire, after all earlier slices.

    What a slice does to that number is a map of 1 to ``threshold`` to itself, worked out
    for each slice alone. Maps compose. A slice that forgets where it started (its map is
    constant) begins a chain of its own; within a chain, maps are composed by blocks of
    slices, then the few blocks are gone through, then the slices of each block.
    """
    by_key = Window.partitionBy("group_key").orderBy("_slice")
    met = slices.join(totals, ["group_key", "_slice"]).withColumn("skip", F.lead("before").over(by_key) - F.col("before"))
    after = f"greatest(1, least({threshold}, {_may_fire_from('runs', 'start', threshold)} - coalesce(skip, {threshold} + 0L)))"
    mapped = met.withColumn("after", F.expr(f"transform(sequence(1L, {threshold}L), start -> cast({after} as bigint))"))
    forgets = F.array_min("after") == F.array_max("after")
    # The slice after one that forgets starts a chain, and knows where.
    starts = F.lag(F.when(forgets, F.element_at("after", 1)), 1).over(by_key)
    chained = mapped.withColumn("known", F.when(F.row_number().over(by_key) == 1, F.lit(1).cast("bigint")).otherwise(starts))
    chained = chained.withColumn("chain", F.count("known").over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    in_chain = Window.partitionBy("group_key", "chain").orderBy("_slice")
    chained = chained.withColumn("block", F.floor((F.row_number().over(in_chain) - 1) / CHAIN_BLOCK))
    blocks = chained.groupBy("group_key", "chain", "block").agg(
        F.array_sort(F.collect_list(F.struct("_slice", "before", "runs", "after"))).alias("steps"), F.max("known").alias("known")
    )
    blocks = blocks.withColumn("after", F.expr(f"transform(sequence(1L, {threshold}L), start -> {_after('steps', 'start')})"))
    # One row for each block of a chain: where it starts follows from the blocks before it.
    earlier = F.collect_list(F.struct("block", "after", "known")).over(
        Window.partitionBy("group_key", "chain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    )
    entered = blocks.withColumn("earlier", earlier).withColumn(
        "start", F.expr(f"if(size(earlier) = 0, known, {_after('earlier', 'earlier[0].known')})")
    )
    followed = (
        "aggregate(steps, named_struct('free', start, 'seen', cast(array() as array<bigint>)), (acc, step) -> "
        "named_struct('free', element_at(step.after, cast(acc.free as int)), 'seen', concat(acc.seen, array(acc.free))), acc -> acc.seen)"
    )
    return (
        entered.select("group_key", F.explode(F.arrays_zip("steps", F.expr(followed).alias("free"))).alias("s"))
        .select("group_key", "s.steps._slice", "s.steps.before", "s.steps.runs", "s.free")
    )


def fire_and_reset(
    df: DataFrame,
    key: Column,
    window_seconds: int,
    threshold: int,
    ts: str = "timestamp",
    tie: str = "event_id",
    copies: bool = False,
) -> DataFrame:
    """Fire when ``threshold`` rows of a key lie within the window, then start over.

    Rows count in (time, id) order; both ends of the window belong to it. Returns
    ``group_key``, ``fired_at``, ``fired_id``, ``matched`` (the row count, always
    the threshold) and ``evidence``, the times of the first rows that count. With
    ``copies`` also ``fired_copy``: which of the key's rows of that time and id it was.

    Rows without a time do not count. Method. Number a key's rows. A row is a candidate when the row
    threshold - 1 places before it is inside the window; it fires when it is also at
    least ``threshold`` rows after the last firing row. Candidates form runs of adjacent
    rows, and within a run every threshold-th row fires, so a run only needs to
    know its first firing row, which follows from the runs before it.

    Rows are windowed by (key, slice), see ``slices``; runs are gone through within each
    slice. From slice to slice only the number of rows until the key may fire again
    matters, see ``_entered``: what meets per key is one row per slice.
    """
    rows = df.select(
        key.alias("group_key"),
        F.unix_micros(F.col(ts).cast("timestamp")).alias("us"),
        F.col(tie).alias("id"),
    ).filter(F.col("us").isNotNull())
    if threshold == 1:
        # Each row fires at once: nothing to window, and nothing to shuffle unless alike rows are to be numbered.
        copy = F.lit(1)
        if copies:
            rows = rows.groupBy("group_key", "us", "id").agg(F.count(F.lit(1)).cast("int").alias("rows"))
            copy = F.explode(F.sequence(F.lit(1), F.col("rows")))
        return _fires(rows.select("*", F.array("us").alias("evidence_us"), copy.alias("copy")), 1, copies)

    window_us = window_seconds * MICROS
    slice_us = window_us * LOOKBACKS_PER_SLICE
    sliced = with_slices(rows, "us", window_us, slice_us)
    place = slice_window(["group_key"], "us", "id")
    shown = min(threshold, EVIDENCE)
    numbered = sliced.select(
        "*",
        F.sum(F.col("_own").cast("bigint"))
        .over(place.rowsBetween(Window.unboundedPreceding, 0))
        .alias("n"),
        F.array(*[F.lag("us", threshold - 1 - i).over(place) for i in range(shown)]).alias(
            "evidence_us"
        ),
        (F.row_number().over(place) - F.rank().over(place) + 1).alias("copy"),
    )
    candidates = numbered.filter(
        F.col("_own") & (F.col("us") - F.col("evidence_us")[0] <= window_us)
    ).withColumn("run", F.col("n") - F.row_number().over(place))

    offsets = slice_offsets(
        rows.groupBy("group_key", home_slice("us", slice_us).alias("_slice")).agg(
            F.count(F.lit(1)).alias("rows")
        ),
        ["group_key"],
        "rows",
        "before",
    )
    slices = (
        candidates.groupBy("group_key", "_slice", "run")
        .agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
        .groupBy("group_key", "_slice")
        .agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "run"))).alias("runs"))
    )
    # Where each run fires first, if at all; one row per slice, as the candidates are partitioned.
    first = "greatest(run.lo, acc.free)"
    starts = _entered(slices, offsets, threshold).select(
        "group_key",
        "_slice",
        F.expr(
            f"""map_from_entries(aggregate(runs,
              named_struct('free', free, 'firsts', cast(array() as array<struct<run: bigint, first: bigint>>)),
              (acc, run) -> if({first} <= run.hi,
                named_struct('free', {first} + ((run.hi - {first}) div {threshold}) * {threshold} + {threshold},
                  'firsts', concat(acc.firsts, array(named_struct('run', run.run, 'first', {first})))),
                acc),
              acc -> acc.firsts))"""
        ).alias("first_of_run"),
    )
    fired = (
        candidates.join(starts, ["group_key", "_slice"])
        .withColumn("first", F.try_element_at("first_of_run", F.col("run")))
        .filter((F.col("n") >= F.col("first")) & ((F.col("n") - F.col("first")) % threshold == 0))
    )
    return _fires(fired, threshold, copies)


def _fires(fired: DataFrame, threshold: int, copies: bool) -> DataFrame:
    return fired.select(
        "group_key",
        F.timestamp_micros("us").alias("fired_at"),
        F.col("id").alias("fired_id"),
        F.lit(threshold).alias("matched"),
        F.transform("evidence_us", F.timestamp_micros).alias("evidence"),
        *([F.col("copy").alias("fired_copy")] if copies else []),
    )


def with_rule_facts(fires: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Firings with name, severity, response and window of their rule."""

    def of_rule(attribute: str) -> Column:
        pairs = [x for r in rules for x in (F.lit(r.rule_id), F.lit(getattr(r, attribute)))]
        return F.element_at(F.create_map(*pairs), F.col("rule_id"))

    return fires.select(
        "rule_id",
        of_rule("name").alias("rule_name"),
        of_rule("severity").alias("severity"),
        of_rule("response").alias("response"),
        of_rule("window_seconds").alias("window_seconds"),
        "group_key",
        "fired_at",
        "fired_id",
        "fired_copy",
        "matched",
        "evidence",
    )


def rule_matches(events: DataFrame, rules: Sequence[Rule] = BUILT_IN_RULES) -> DataFrame:
    """All firings of all enabled rules.

    Each rule scans with its own pushed-down predicate and only the columns it
    needs. ``fired_copy`` tells firings of alike rows (key, time, id) apart.
    """
    active = check_rules(rules)
    if not active:
        raise ValueError("no rule is enabled")
    branches = []
    for rule in active:
        relevant = events.filter(F.expr(rule.predicate))
        fires = fire_and_reset(relevant, F.expr(rule.key), rule.window_seconds, rule.threshold, copies=True)
        branches.append(fires.select(F.lit(rule.rule_id).alias("rule_id"), "*"))
    return with_rule_facts(reduce(DataFrame.unionByName, branches), active)


def matches_to_alerts(matches: DataFrame) -> DataFrame:
    """Alert rows for rule firings, dated by the event that completed the match."""
    narrative = F.format_string(
        MATCH_SENTENCE,
        "rule_name",
        "matched",
        "group_key",
        "window_seconds",
        "response",
    )
    return matches.select(
        F.xxhash64("rule_id", "group_key", "fired_at", "fired_id", "fired_copy").alias("alert_id"),
        F.transform("evidence", iso_text).alias("event_cluster"),
        "severity",
        narrative.alias("narrative"),
        F.lit(0).alias("acknowledged"),
        F.col("fired_at").alias("created_at"),
    ).select(*ALERT_COLUMNS)


def recent_matches(matches: DataFrame, n: int = RECENT) -> DataFrame:
    """The last ``n`` firings, newest first."""
    return matches.orderBy(
        F.col("fired_at").desc(), F.col("fired_id").desc(), F.col("rule_id").desc()
    ).limit(n)
