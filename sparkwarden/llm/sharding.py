"""Shards that all hold the sources in the proportions of the whole table.

Proportional stratified interleaving: the rows of a source are put into a seeded
random order and get the fractional rank (rank - 1/2) / rows of the source.
Sorted by that fraction the sources interleave evenly, so any run of the order
holds each source in proportion, and cutting it into equal runs gives the shards.

Both orders are global, yet no task sorts more than its range of rows: ranges are
cut by all columns of the order and a row's number, so neither rows without id nor
many small sources meet in one task; running counts of the ranges give each row its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import placed
from .tables import stored

LAW = "rows"


def interleaved_shards(
    docs: DataFrame,
    shards: int = 24,
    seed: int = 7,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of `docs` with its shard and its place there.

    Law ``rows``: shard sizes differ by one row at most, and in each shard a
    source has its share of the table up to a few rows. Columns: the id, size
    (UTF-8 bytes of the text plus 8), text_crc32, law, shard (from 0), slot
    (gapless from 0), grown_shard (null: the ``rows`` law does not promise that
    rows stay when a shard is added).

    A null text has size 8 and the checksum of the empty text. A null source is a
    source of its own. A null id is ordered as the text ``null``. Repeated rows
    are all kept and get places of their own; rows equal in id, checksum and
    size may swap places, which changes no output row. An empty table gives no
    rows. Other columns of `docs` do not matter.
    """
    if shards < 1:
        raise ValueError("shards must be at least 1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("tree"),
        (F.octet_length(text) + 8).cast("long").alias("_size"),
        F.crc32(F.encode(text, "UTF-8")).alias("_crc"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).cast("binary")).alias("_key"),
    )

    shuffled = placed(stored(base, "shuffle"), ["_key", "_id", "_crc", "_size"], "shuffled")
    fraction = (F.col("place") * 2 + 1).cast("double") / (F.col("total") * 2).cast("double")
    rows = shuffled.select(
        F.lit("").alias("tree"), "_id", F.col("tree").alias("_source"), "_size", "_crc", "_key", fraction.alias("_fraction")
    )
    order = ["_fraction", "_source", "_key", "_id", "_crc", "_size"]
    place = placed(stored(rows, "interleave"), order, "interleaved").withColumn("_shard", F.expr(f"(place * {shards}) div total"))
    return place.select(
        F.col("_id").alias(id_col),
        F.col("_size").alias("size"),
        F.col("_crc").alias("text_crc32"),
        F.lit(LAW).alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.expr(f"place - (_shard * total + {shards - 1}) div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
