"""Sequences of events on a stream: Spark's join of two watermarked streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.slices import LOOKBACKS_PER_SLICE, MICROS, home_slice, with_slices


def stream_followed_by(
    events: DataFrame,
    first: Column,
    then: Column,
    key: Column,
    within_seconds: int = 180,
    delay: str = "10 minutes",
    ts: str = "timestamp",
    tie: str = "event_id",
    columns: Sequence[str] | None = None,
    salts: int = 4,
) -> DataFrame:
    """``followed_by`` on a stream: ``then`` rows with an earlier ``first`` row of the same key, and its time.

    Both kinds of rows are read as streams of their own and joined by an interval of event
    time, so either side's rows leave the state once no row can meet them any more. A
    second stateful step keeps the nearest ``first`` row of each ``then`` row and emits
    it when the watermark has passed. Rows later than ``delay`` are dropped; rows without
    a time take no part. ``then`` rows alike in time, ``tie`` and key come once. A key is cut
    into time slices: the join looks up its state by equality only, so a ``then`` row meets
    the ``first`` rows of its slice and not all those of its key that a micro-batch brings.
    ``then`` rows of a slice are dealt out to ``salts`` groups, and its ``first`` rows go to each of them.
    """
    within_us = int(within_seconds) * MICROS
    slice_us = max(within_us, MICROS) * LOOKBACKS_PER_SLICE
    carried = list(dict.fromkeys([*(columns or events.columns), tie]))
    timed = events.withWatermark(ts, delay)
    there = F.col(ts).isNotNull()
    # The test holds the time, so that it is made after the watermark has seen the row.
    firsts = timed.filter(F.when(there, first)).select(
        key.alias("_first_key"),
        F.col(ts).alias("_first_at"),
        F.unix_micros(ts).alias("_us"),
        F.col(tie).alias("_first_id"),
    )
    starts = with_slices(firsts, "_us", within_us, slice_us).select(
        "_first_key",
        "_first_at",
        "_first_id",
        F.col("_slice").alias("_first_slice"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_first_salt"),
    )
    ends = timed.filter(F.when(there, then)).select(
        key.alias("_key"),
        F.col(ts).alias("_at"),
        F.col(tie).alias("_id"),
        home_slice(f"unix_micros(`{ts}`)", slice_us).alias("_slice"),
        F.pmod(F.xxhash64(tie), F.lit(salts)).cast("int").alias("_salt"),
        F.struct(*[c for c in carried if c != ts]).alias("_row"),
    )
    met = ends.join(
        starts,
        F.expr(
            f"""_key = _first_key and _slice = _first_slice and _salt = _first_salt
            and _first_at <= _at and _first_at >= _at - interval {int(within_seconds)} seconds
            and (_first_at < _at or _first_id < _id)"""
        ),
    )
    nearest = (
        met.select("_at", "_key", "_id", "_row", F.unix_micros("_first_at").alias("_first_us"))
        .groupBy("_at", "_key", "_id")
        .agg(F.max("_first_us").alias("_first_us"), F.first("_row").alias("_row"))
    )
    found = nearest.select(F.col("_at").alias(ts), "_row.*", F.timestamp_micros("_first_us").alias("first_at"))
    return found.select(*[c for c in carried if c in found.columns], "first_at")
