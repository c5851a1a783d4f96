"""Ranks within groups of any size, without sorting a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

CELLS = 1024


def with_ranks(df: DataFrame, group: str, order: Sequence[str], rank: str, cells: int = CELLS) -> DataFrame:
    """`df` with the row's rank (from 0) in its group, in a fixed random order of the columns `order`.

    A group is cut into cells by a hash of `order`; a running count over the cells (at
    most `cells` rows a group) and the place within a cell give the rank. Rows alike in
    `order` get adjacent ranks. `group` must not be null.
    """
    mixed: Column = F.xxhash64(*[F.col(c) for c in order])
    celled = df.withColumn("_cell", F.pmod(mixed, F.lit(cells)).cast("int"))
    before = Window.partitionBy(group).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    counts = (
        celled.groupBy(group, "_cell")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(group, "_cell", (F.sum("_n").over(before) - F.col("_n")).alias("_before"))
    )
    place = Window.partitionBy(group, "_cell").orderBy(*order)
    ranked = celled.join(counts, [group, "_cell"])
    return ranked.withColumn(rank, F.col("_before") + F.row_number().over(place) - 1).drop("_cell", "_before")


def placed(rows: DataFrame, order: Sequence[str], purpose: str) -> DataFrame:
    """`rows` with `place`, the row's number (from 0) within its `tree` by `order`, and `total`, the tree's rows.

    Rows are sorted by range once, over all trees, so a large tree spreads over many
    tasks; equal rows are told apart by a number. The running counts have one row for
    each tree in each sorted part.
    """
    keys = ["tree", *order, "_copy"]
    numbered = rows.withColumn("_copy", F.monotonically_increasing_id() % 4096)
    in_order = numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_copy")
    parted = stored(in_order.withColumn("_at", F.monotonically_increasing_id()), purpose)
    parted = parted.withColumn("_part", F.shiftright("_at", 33))
    tree = Window.partitionBy("tree")
    so_far = F.sum("_n").over(tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0))
    runs = parted.groupBy("tree", "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select("tree", "_part", (so_far - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(tree).alias("total"))
    met = parted.join(runs, ["tree", "_part"])
    return met.withColumn("place", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")
