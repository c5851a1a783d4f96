"""Keyed time windows that do not need a whole key in one task.

A key's rows are cut into time slices. Rows within ``lookback`` of the end of a
slice are also copied into the next one, so whatever looks back that far from a
row finds everything in the row's own slice. Windows partitioned by
(key, slice) then give the same answer as windows partitioned by key, and a key
that holds a large part of the table spreads over as many tasks as it has slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

MICROS = 1_000_000

# Slice length in lookbacks: one copied row in four at an even rate.
LOOKBACKS_PER_SLICE = 4


def home_slice(us: str, slice_us: int) -> Column:
    """Number of the slice a time in microseconds lies in (floor, also before 1970)."""
    return F.expr(f"({us} - pmod({us}, {slice_us})) div {slice_us}")


def with_slices(df: DataFrame, us: str, lookback_us: int, slice_us: int) -> DataFrame:
    """Adds ``_slice`` and ``_own`` (false for a row copied from the slice before)."""
    if slice_us < lookback_us:
        raise ValueError("a slice must not be shorter than the lookback")
    home = home_slice(us, slice_us)
    copied = F.pmod(F.col(us), F.lit(slice_us)) >= slice_us - lookback_us
    return df.select(
        "*",
        F.explode(F.when(copied, F.array(home, home + 1)).otherwise(F.array(home))).alias(
            "_slice"
        ),
    ).withColumn("_own", F.col("_slice") == home)


def slice_window(keys: Sequence[str], *order: str) -> WindowSpec:
    return Window.partitionBy(*keys, "_slice").orderBy(*order)


def slice_offsets(totals: DataFrame, keys: Sequence[str], value: str, offset: str) -> DataFrame:
    """Running total of ``value`` over a key's earlier slices, one row per slice.

    ``totals`` has one row per (key, slice): its size follows the time span of a
    key, not the number of its rows.
    """
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(
        *keys, "_slice", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(offset)
    )
