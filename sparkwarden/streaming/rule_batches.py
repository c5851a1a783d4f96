"""Rule detection on a stream with hot keys.

Each micro-batch runs the batch operator, whose windows are cut by time slice, so
no key has to fit into one task or one state entry. What a batch leaves for the next
one are two small things: the rows the watermark has not passed and, per key, the
fewer than ``threshold`` rows of the open window. Starting the batch operator with
the rows of an open window is the same as having kept that window.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import (
    BUILT_IN_RULES,
    Rule,
    check_rules,
    fire_and_reset,
    rule_hits,
    with_rule_facts,
)
from ..operators.slices import MICROS
from ..session import drop_folder

_ROWS = "rule_id string, group_key string, timestamp timestamp, event_id bigint"
_FIRES = (
    "rule_id string, group_key string, fired_at timestamp, fired_id bigint, matched int, "
    "evidence array<timestamp>, fired_copy int"
)
_CLOCK = "watermark_us bigint, late_rows bigint"


def _open_rows(passed: DataFrame, fires: DataFrame, rules: Sequence[Rule], watermark_us: int):
    """Rows after a key's last firing that the next event could still count."""
    windows = F.create_map(
        *[x for r in rules for x in (F.lit(r.rule_id), F.lit(r.window_seconds * MICROS))]
    )
    reach = watermark_us - F.element_at(windows, F.col("rule_id"))
    last = fires.groupBy("rule_id", "group_key").agg(
        F.max(F.struct("fired_at", "fired_id", "fired_copy")).alias("last")
    )
    # Rows of one time and id are alike; as many of them are used as the firing one's place says.
    alike = Window.partitionBy("rule_id", "group_key", "timestamp", "event_id").orderBy("event_id")
    place = F.struct(
        F.col("timestamp").alias("fired_at"), F.col("event_id").alias("fired_id"), F.row_number().over(alike).alias("fired_copy")
    )
    return (
        passed.withColumn("place", place).filter(F.unix_micros("timestamp") >= reach)
        .join(last, ["rule_id", "group_key"], "left")
        .filter(F.col("last").isNull() | (F.col("place") > F.col("last")))
        .select("rule_id", "group_key", "timestamp", "event_id")
    )


def run_rule_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    rules: Sequence[Rule] = BUILT_IN_RULES,
    delay_seconds: int = 600,
    once: bool = True,
) -> StreamingQuery:
    """Detect on a stream and write firings below ``path``; see ``read_rule_stream``.

    The watermark is the newest time seen less the delay; rows that arrive behind it
    are counted, not used. All output of a micro-batch goes to folders named by its
    number, so repeating a failed batch replaces what it had written.
    """
    active = check_rules(rules)

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        kept, before_us = None, None
        if batch_id > 0:
            kept = spark.read.schema(_ROWS).parquet(f"{path}/rows/batch={batch_id - 1}")
            clock = spark.read.schema(_CLOCK).parquet(f"{path}/clock/batch={batch_id - 1}")
            before_us = clock.first()["watermark_us"]
        # What the passes over the batch need is narrow: which rules an event counts for, and its time.
        batch = batch.select("us", "timestamp", "event_id", rule_hits(active).alias("hits")).persist()
        try:
            late = F.lit(False) if before_us is None else F.col("us") <= before_us
            seen = batch.agg(F.max("us").alias("newest"), F.count_if(late).alias("late")).first()
            reached = [before_us, None if seen.newest is None else seen.newest - delay_seconds * MICROS]
            reached = [us for us in reached if us is not None]
            watermark_us = max(reached) if reached else -(2**62)
            rows = batch.filter(~late).select(F.inline("hits"), "timestamp", "event_id")
            rows = rows if kept is None else rows.unionByName(kept)
            passed = F.unix_micros("timestamp") <= watermark_us
            fired = []
            for rule in active:
                fires = fire_and_reset(
                    rows.filter(passed & (F.col("rule_id") == rule.rule_id)),
                    F.col("group_key"),
                    rule.window_seconds,
                    rule.threshold,
                    copies=True,
                )
                fired.append(fires.select(F.lit(rule.rule_id).alias("rule_id"), "*"))
            fires_path = f"{path}/fires/batch={batch_id}"
            reduce(DataFrame.unionByName, fired).write.mode("overwrite").parquet(fires_path)
            written = spark.read.schema(_FIRES).parquet(fires_path)
            windowed = [r for r in active if r.threshold > 1]
            left = rows.filter(~passed)
            if windowed:
                waiting = rows.filter(
                    passed & F.col("rule_id").isin(*[r.rule_id for r in windowed])
                )
                left = left.unionByName(_open_rows(waiting, written, windowed, watermark_us))
            left.write.mode("overwrite").parquet(f"{path}/rows/batch={batch_id}")
            # The clock comes last: a batch counts once its clock is there.
            spark.createDataFrame([(watermark_us, seen.late)], _CLOCK).write.mode(
                "overwrite"
            ).parquet(f"{path}/clock/batch={batch_id}")
            # This batch may be repeated and reads the one before; older rows are done with.
            if batch_id > 1:
                drop_folder(spark, f"{path}/rows/batch={batch_id - 2}")
        finally:
            batch.unpersist()

    timed = events.withColumn("us", F.unix_micros("timestamp"))
    writer = timed.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _finished(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{_CLOCK}, batch bigint").parquet(f"{path}/clock")


def read_rule_stream(
    spark: SparkSession, path: str, rules: Sequence[Rule] = BUILT_IN_RULES
) -> DataFrame:
    """Firings of all finished micro-batches, in the form of ``rule_matches``."""
    try:
        done = _finished(spark, path).agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return with_rule_facts(spark.createDataFrame([], _FIRES), rules)
    fires = spark.read.schema(f"{_FIRES}, batch bigint").parquet(f"{path}/fires").filter(F.col("batch") <= done)
    return with_rule_facts(fires.drop("batch"), rules)


def late_rows(spark: SparkSession, path: str) -> int:
    """Rows that came behind the watermark, over all finished micro-batches."""
    return _finished(spark, path).agg(F.coalesce(F.sum("late_rows"), F.lit(0))).first()[0]
