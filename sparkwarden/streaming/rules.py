"""Rule detection on a stream, equal to the batch result."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import (
    BUILT_IN_RULES,
    EVIDENCE,
    Rule,
    check_rules,
    match_rules,
    with_rule_facts,
)
from ..operators.slices import MICROS

_FIRES = (
    "rule_id string, group_key string, fired_us bigint, fired_id bigint, fired_copy int, evidence_us array<bigint>"
)
# Rows the watermark has not passed yet, and the open window's times.
_STATE = "pending_us array<bigint>, pending_id array<bigint>, open_us array<bigint>"


def _fold(
    rows: list[tuple[int, int]], open_us: list[int], window_us: int, threshold: int
) -> tuple[list[tuple[int, int, int, list[int]]], list[int]]:
    """Fires among rows in order, and the window left open."""
    fires, last, copy = [], None, 0
    for us, row_id in rows:
        # Rows of one time pass the watermark together, so copies are numbered here.
        last, copy = (us, row_id), copy + 1 if last == (us, row_id) else 1
        open_us.append(us)
        open_us = [t for t in open_us if t >= us - window_us]
        if len(open_us) >= threshold:
            fires.append((us, row_id, copy, open_us[:EVIDENCE]))
            open_us = []
    return fires, open_us


def stream_rule_matches(
    events: DataFrame, rules: Sequence[Rule] = BUILT_IN_RULES, delay: str = "10 minutes"
) -> DataFrame:
    """Firings of the rules on a stream of events, at low latency.

    A key's rows of one delay must fit into a task; for keys that hold a large
    part of a busy stream use ``rule_batches``. Rows wait in keyed state until the watermark has passed them and are then
    folded in (time, id) order, so the arrival order does not matter. State per key
    is the rows younger than the watermark and fewer than ``threshold`` times; an
    idle key is dropped one window after its last row. Rows later than ``delay``
    are not counted. Rules of threshold 1 need no state: they read the source a
    second time instead of sending their rows through it. Without state they cannot
    number alike rows (key, time, id): those of one such rule all have ``fired_copy`` 1,
    where ``rule_batches`` numbers them.
    """
    active = check_rules(rules)
    limits = {r.rule_id: (r.window_seconds * MICROS, r.threshold) for r in active}

    def step(
        key: tuple[str, str], chunks: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        rule_id, group_key = key
        window_us, threshold = limits[rule_id]
        pending, open_us = [], []
        if state.exists:
            pending_us, pending_id, kept = state.get
            pending = list(zip(pending_us, pending_id, strict=True))
            open_us = list(kept)
        # Rows of one key may come in several chunks: gather all before folding.
        for chunk in chunks:
            pending.extend(zip(chunk["us"].tolist(), chunk["id"].tolist(), strict=True))
        passed_ms = state.getCurrentWatermarkMs()
        passed_us = passed_ms * 1000
        final = sorted(r for r in pending if r[0] <= passed_us)
        pending = [r for r in pending if r[0] > passed_us]
        fires, open_us = _fold(final, open_us, window_us, threshold)
        open_us = [t for t in open_us if t >= passed_us - window_us]
        if pending or open_us:
            state.update(
                ([r[0] for r in pending], [r[1] for r in pending], open_us)
            )
            wake_us = min(r[0] for r in pending) if pending else open_us[-1] + window_us
            state.setTimeoutTimestamp(max(wake_us // 1000 + 1, passed_ms + 1))
        elif state.exists:
            state.remove()
        if fires:
            yield pd.DataFrame(
                {
                    "rule_id": rule_id,
                    "group_key": group_key,
                    "fired_us": [f[0] for f in fires],
                    "fired_id": [f[1] for f in fires],
                    "fired_copy": [f[2] for f in fires],
                    "evidence_us": [f[3] for f in fires],
                }
            )

    tagged = (
        match_rules(events.withWatermark("timestamp", delay), active)
        .select(
            "rule_id",
            "group_key",
            "timestamp",
            F.unix_micros("timestamp").alias("us"),
            F.col("event_id").alias("id"),
        )
    )
    instant = [r.rule_id for r in active if r.threshold == 1]
    kept = [r.rule_id for r in active if r.threshold > 1]
    branches = []
    if kept:
        branches.append(
            tagged.filter(F.col("rule_id").isin(*kept))
            .groupBy("rule_id", "group_key")
            .applyInPandasWithState(
                step, _FIRES, _STATE, "append", GroupStateTimeout.EventTimeTimeout
            )
        )
    if instant:
        branches.append(
            tagged.filter(F.col("rule_id").isin(*instant)).select(
                "rule_id",
                "group_key",
                F.col("us").alias("fired_us"),
                F.col("id").alias("fired_id"),
                F.lit(1).alias("fired_copy"),
                F.array("us").alias("evidence_us"),
            )
        )
    fires = branches[0] if len(branches) == 1 else branches[0].unionByName(branches[1])

    limit_of = F.create_map(*[x for r in active for x in (F.lit(r.rule_id), F.lit(r.threshold))])
    return with_rule_facts(
        fires.select(
            "rule_id",
            "group_key",
            F.timestamp_micros("fired_us").alias("fired_at"),
            "fired_id",
            "fired_copy",
            F.element_at(limit_of, F.col("rule_id")).alias("matched"),
            F.transform("evidence_us", F.timestamp_micros).alias("evidence"),
        ),
        active,
    )
