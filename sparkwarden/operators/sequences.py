"""Sliding views of keyed events: counts, sequences, distinct values, deviations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .slices import LOOKBACKS_PER_SLICE, MICROS, home_slice, slice_offsets, slice_window, with_slices


def _us(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def rolling_count(
    df: DataFrame,
    key: Column,
    window_seconds: int,
    ts: str = "timestamp",
    out: str = "rolling",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Adds the number of the key's rows in the window that ends at each row.

    A row counts from its time until the window length after it, so the number is a
    running sum of +1 at each row and -1 just after it leaves. That is linear in the
    rows, where a sliding frame would visit every row of the window for each row.
    ``columns`` are those that go through the shuffle and come out; default all.
    """
    window_us = window_seconds * MICROS
    keyed = df.select(key.alias("_key"), _us(ts).alias("_us"), F.struct(*(columns or df.columns)).alias("_row"))
    sliced = with_slices(keyed, "_us", window_us, window_us * LOOKBACKS_PER_SLICE)
    comes = F.struct(
        F.col("_us").alias("at"), F.lit(1).alias("delta"), F.when(F.col("_own"), F.col("_row")).alias("row")
    )
    leaves = F.struct(
        (F.col("_us") + window_us + 1).alias("at"),
        F.lit(-1).alias("delta"),
        F.when(F.lit(False), F.col("_row")).alias("row"),
    )
    steps = sliced.select("_key", "_slice", F.inline(F.array(comes, leaves)))
    so_far = slice_window(["_key"], "at").rangeBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn(out, F.sum("delta").over(so_far))
        .filter(F.col("row").isNotNull())
        .select("row.*", out)
    )


def followed_by(
    df: DataFrame,
    first: Column,
    then: Column,
    key: Column,
    within_seconds: int = 180,
    ts: str = "timestamp",
    tie: str = "event_id",
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """``then`` rows with an earlier ``first`` row of the same key, and that row's time.

    The nearest earlier row counts. One window pass, no self-join; rows that are
    neither first nor then are dropped before the shuffle. ``columns`` are those that go
    through it and come out, ``tie`` always; default all.
    """
    carried = list(dict.fromkeys([*(columns or df.columns), tie]))
    within_us = within_seconds * MICROS
    keyed = (
        df.withColumn("_first", F.coalesce(first, F.lit(False)))
        .withColumn("_then", F.coalesce(then, F.lit(False)))
        .filter("_first or _then")
        .withColumn("_key", key)
        .withColumn("_us", _us(ts))
        .select(*carried, "_first", "_then", "_key", "_us")
    )
    sliced = with_slices(keyed, "_us", within_us, within_us * LOOKBACKS_PER_SLICE)
    before = slice_window(["_key"], "_us", tie).rowsBetween(Window.unboundedPreceding, -1)
    first_us = F.last(F.when(F.col("_first"), F.col("_us")), ignorenulls=True).over(before)
    return (
        sliced.withColumn("_first_us", first_us)
        .filter(F.col("_own") & F.col("_then") & (F.col("_us") - F.col("_first_us") <= within_us))
        .withColumn("first_at", F.timestamp_micros("_first_us"))
        .drop("_first", "_then", "_key", "_us", "_slice", "_own", "_first_us")
    )


def distinct_in_window(
    df: DataFrame,
    key: Column,
    item: Column,
    window_seconds: int = 60,
    threshold: int = 50,
    ts: str = "timestamp",
    tie: str = "event_id",
) -> DataFrame:
    """Rows at which the key has met more than ``threshold`` distinct items in the window.

    Exact, without a set per row. An item is active from one of its rows until the
    window length after it; overlapping spans of an item are one span. The
    distinct count at a time is the number of active items, a running sum of
    +1 at the begin and -1 just after the end of each span.

    Two rows of an item in the same window-long cell are never further apart than
    the window, so a cell's first and last row describe it: the first aggregation
    is partial before its shuffle and indifferent to hot keys and items.
    """
    window_us = window_seconds * MICROS
    slice_us = window_us * LOOKBACKS_PER_SLICE
    rows = df.select(
        key.alias("group_key"), item.alias("item"), _us(ts).alias("us"), F.col(tie).alias("id")
    ).filter(F.col("item").isNotNull())

    cells = rows.groupBy("group_key", "item", home_slice("us", window_us).alias("cell")).agg(
        F.min("us").alias("lo"), F.max("us").alias("hi")
    )
    of_item = Window.partitionBy("group_key", "item").orderBy("cell")
    edges = cells.select(
        "group_key",
        F.when(
            F.coalesce(F.col("lo") - F.lag("hi").over(of_item) > window_us, F.lit(True)),
            F.struct(F.col("lo").alias("us"), F.lit(1).alias("delta")),
        ).alias("begin"),
        F.when(
            F.coalesce(F.lead("lo").over(of_item) - F.col("hi") > window_us, F.lit(True)),
            F.struct((F.col("hi") + window_us + 1).alias("us"), F.lit(-1).alias("delta")),
        ).alias("end"),
    )
    changes = (
        edges.select("group_key", F.explode(F.array_compact(F.array("begin", "end"))).alias("e"))
        .groupBy("group_key", F.col("e.us").alias("us"))
        .agg(F.sum("e.delta").alias("delta"))
    )
    steps = changes.withColumn("id", F.lit(None).cast("bigint")).unionByName(
        rows.select("group_key", "us", "id", F.lit(0).cast("bigint").alias("delta"))
    ).withColumn("_slice", home_slice("us", slice_us))
    offsets = slice_offsets(
        steps.groupBy("group_key", "_slice").agg(F.sum("delta").alias("change")),
        ["group_key"],
        "change",
        "active_before",
    )
    span = slice_window(["group_key"], "us").rangeBetween(Window.unboundedPreceding, 0)
    return (
        steps.withColumn("change", F.sum("delta").over(span))
        .filter(F.col("id").isNotNull())
        .join(offsets, ["group_key", "_slice"])
        .select(
            "group_key",
            F.timestamp_micros("us").alias("timestamp"),
            F.col("id").alias("event_id"),
            (F.col("active_before") + F.col("change")).alias("distinct_items"),
        )
        .filter(F.col("distinct_items") > threshold)
    )


def bucket_totals(df: DataFrame, host: Column, amount: Column, bucket: str = "1 hour", ts: str = "timestamp") -> DataFrame:
    """(host, bucket, total): the amounts of each host in each bucket of time."""
    return (
        df.groupBy(host.alias("host"), F.window(F.col(ts), bucket).alias("w"))
        .agg(F.sum(amount).alias("total"))
        .select("host", F.col("w.start").alias("bucket"), "total")
    )


def _moments(window: WindowSpec) -> Column:
    """Count, mean and sum of squared deviations of the totals, as Spark updates them row by row."""
    n = F.count("total").over(window)
    return F.struct(
        n.cast("double").alias("n"),
        F.coalesce(F.avg("total").over(window), F.lit(0.0)).alias("mean"),
        F.coalesce(F.var_pop("total").over(window) * n, F.lit(0.0)).alias("m2"),
    )


def deviating_buckets(totals: DataFrame, n_std: float = 3.0, history: int = 720, min_samples: int = 30) -> DataFrame:
    """Of (host, bucket, total) the buckets more than ``n_std`` deviations above the host's past.

    The past are the ``history`` buckets before. A host's buckets are cut into blocks of
    that many; a past is then the end of one block and the begin of the next. Moments of
    all begins and all ends of a block are running values, and two of them are merged
    (count, mean, squared deviations), so the work is linear in the buckets and nothing
    is ever subtracted: large totals lose no precision.
    """
    by_host = Window.partitionBy("host").orderBy("bucket")
    numbered = totals.withColumn("_n", F.row_number().over(by_host) - 1).withColumn("_block", F.floor(F.col("_n") / history))
    block = Window.partitionBy("host", "_block")
    begins = _moments(block.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = _moments(block.orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    halves = numbered.withColumn("_end", ends).withColumn("_a", begins).withColumn("_b", F.lag("_end", history).over(by_host))
    none = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    halves = halves.withColumn("_b", F.coalesce("_b", none))
    n = F.col("_a.n") + F.col("_b.n")
    delta = F.col("_b.mean") - F.col("_a.mean")
    mean = F.col("_a.mean") + delta * F.col("_b.n") / n
    m2 = F.col("_a.m2") + F.col("_b.m2") + delta * delta * F.col("_a.n") * F.col("_b.n") / n
    return (
        halves.withColumn("samples", n.cast("bigint"))
        .filter((F.col("samples") >= min_samples) & (F.col("samples") > 0))
        .withColumns({"mean": mean, "std": F.sqrt(m2 / n)})
        .filter(F.col("total") > F.col("mean") + n_std * F.col("std"))
        .select("host", "bucket", "total", "samples", "mean", "std")
    )


def deviation_from_baseline(
    df: DataFrame,
    host: Column,
    amount: Column,
    bucket: str = "1 hour",
    n_std: float = 3.0,
    history: int = 720,
    min_samples: int = 30,
    ts: str = "timestamp",
) -> DataFrame:
    """Buckets in which a host's total lies more than ``n_std`` deviations above its past.

    The baseline is the mean and population deviation of up to ``history`` earlier
    buckets of the host, once there are ``min_samples`` of them. Events are summed
    before the windows, whose partitions hold one row per bucket.
    """
    return deviating_buckets(bucket_totals(df, host, amount, bucket, ts), n_std, history, min_samples)
