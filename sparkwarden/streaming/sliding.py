"""Sliding operators on a stream, equal to the batch result, with hot keys cut.

Each micro-batch runs the batch operator over the rows the watermark has passed and as
many earlier rows as the operator looks back. What a batch leaves for the next one is a
table of those rows and of the rows not passed yet, so what is kept is bounded by the
window and the delay, no key has to fit into one state entry, and the operator's own
time slices spread a key over tasks.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.sequences import bucket_totals, deviating_buckets, distinct_in_window
from ..operators.slices import MICROS
from ..session import drop_folder, query_id

Operator = Callable[[DataFrame], DataFrame]
_CLOCK = "watermark_us bigint, late_rows bigint"


def run_sliding_stream(
    rows: DataFrame,
    path: str,
    checkpoint: str,
    operator: Operator,
    kept: Callable[[DataFrame, int], DataFrame],
    ts: str = "timestamp",
    out_ts: str = "timestamp",
    delay_seconds: int = 600,
    once: bool = True,
) -> StreamingQuery:
    """Run a batch operator on a stream; its results go below ``path``, see ``read_sliding_stream``.

    ``operator`` gets the passed rows and gives rows that each depend on rows of its own
    time ``out_ts`` and before. ``kept(rows, watermark_us)`` are those of the passed rows that
    later results still need (``younger_than``). Rows without a time are left out; rows
    behind the watermark, the newest time less the delay, are counted and not used.
    Output is written to folders named by the query, whose id stays with the checkpoint,
    and the batch: repeating a failed batch replaces what it had written. Rows kept for
    batches that cannot be repeated any more are deleted.
    """
    schema = rows.schema

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = query_id(spark, checkpoint)

        def folder(what: str, number: int = batch_id) -> str:
            return f"{path}/{what}/run={run}/batch={number}"

        us = F.unix_micros(F.col(ts).cast("timestamp"))
        earlier, before_us = None, None
        if batch_id > 0:
            earlier = spark.read.schema(schema).parquet(folder("rows", batch_id - 1))
            before_us = spark.read.schema(_CLOCK).parquet(folder("clock", batch_id - 1)).first()["watermark_us"]
        batch = batch.filter(F.col(ts).isNotNull()).persist()
        try:
            late = F.lit(False) if before_us is None else us <= before_us
            seen = batch.agg(F.max(us).alias("newest"), F.count_if(late).alias("late")).first()
            reached = [before_us, None if seen.newest is None else seen.newest - delay_seconds * MICROS]
            watermark_us = max([r for r in reached if r is not None], default=-(2**62))
            there = batch.filter(~late)
            there = there if earlier is None else there.unionByName(earlier)
            passed = there.filter(us <= watermark_us)
            found = operator(passed)
            if before_us is not None:
                found = found.filter(F.unix_micros(F.col(out_ts).cast("timestamp")) > before_us)
            found.write.mode("overwrite").parquet(folder("out"))
            left = there.filter(us > watermark_us).unionByName(kept(passed, watermark_us))
            left.write.mode("overwrite").parquet(folder("rows"))
            # The clock comes last: a batch counts once its clock is there.
            clock = spark.createDataFrame([(watermark_us, seen.late)], _CLOCK)
            clock.write.mode("overwrite").parquet(folder("clock"))
            if batch_id > 1:
                drop_folder(spark, folder("rows", batch_id - 2))
        finally:
            batch.unpersist()

    writer = rows.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def younger_than(seconds: int, ts: str = "timestamp") -> Callable[[DataFrame, int], DataFrame]:
    """Rows that a window of so many seconds before a later row can still hold."""

    def kept(passed: DataFrame, watermark_us: int) -> DataFrame:
        return passed.filter(F.unix_micros(F.col(ts).cast("timestamp")) > watermark_us - seconds * MICROS)

    return kept


def read_sliding_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The results of all finished micro-batches of all queries that wrote to ``path``."""
    try:
        clocks = spark.read.schema(f"{_CLOCK}, run string, batch bigint").parquet(f"{path}/clock")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    # One number for each query that ever wrote here.
    last = {r["run"]: r["last"] for r in clocks.groupBy("run").agg(F.max("batch").alias("last")).collect()}
    finished = reduce(Column.__or__, [(F.col("run") == run) & (F.col("batch") <= n) for run, n in sorted(last.items())])
    found = spark.read.schema(f"{schema}, run string, batch bigint").parquet(f"{path}/out")
    return found.filter(finished).drop("run", "batch")


DISTINCT = "group_key string, timestamp timestamp, event_id bigint, distinct_items bigint"


def run_distinct_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    key: Column,
    item: Column,
    window_seconds: int = 60,
    threshold: int = 50,
    delay_seconds: int = 600,
    once: bool = True,
) -> StreamingQuery:
    """``distinct_in_window`` on a stream, exact; read with the schema ``DISTINCT``.

    Items are counted apart by (key, item) and summed, so a scanner with most of the
    rows is spread as in the batch operator. What is kept is one window of narrow rows.
    """
    narrow = events.select(
        key.cast("string").alias("group_key"), item.cast("string").alias("item"), F.col("timestamp").cast("timestamp").alias("timestamp"), "event_id"
    )

    def distinct(rows: DataFrame) -> DataFrame:
        return distinct_in_window(rows, F.col("group_key"), F.col("item"), window_seconds, threshold)

    return run_sliding_stream(
        narrow, path, checkpoint, distinct, younger_than(window_seconds), delay_seconds=delay_seconds, once=once
    )


DEVIATION = "host string, bucket timestamp, total double, samples bigint, mean double, std double"


def run_deviation_stream(
    events: DataFrame,
    path: str,
    checkpoint: str,
    host: Column,
    amount: Column,
    bucket: str = "1 hour",
    n_std: float = 3.0,
    history: int = 720,
    min_samples: int = 30,
    delay: str = "10 minutes",
    once: bool = True,
) -> StreamingQuery:
    """``deviation_from_baseline`` on a stream; read with the schema ``DEVIATION``.

    Spark's own windowed aggregation closes a bucket when the watermark has passed it;
    closed totals come in order of time from then on, and the last ``history`` of each
    host are what is kept. A bucket is final when it closes: later events of it are dropped.
    """
    totals = bucket_totals(events.withWatermark("timestamp", delay), host, amount, bucket)

    def deviating(rows: DataFrame) -> DataFrame:
        return deviating_buckets(rows, n_std, history, min_samples)

    def kept(rows: DataFrame, _: int) -> DataFrame:
        newest_first = Window.partitionBy("host").orderBy(F.desc("bucket"))
        return rows.withColumn("_n", F.row_number().over(newest_first)).filter(F.col("_n") <= history).drop("_n")

    return run_sliding_stream(totals, path, checkpoint, deviating, kept, ts="bucket", out_ts="bucket", delay_seconds=0, once=once)
