"""Full-text search from an index alone: a dictionary of words and postings with positions.

An index is three tables below one folder, each write a segment of its own:

``rows``      the indexed rows, each with a number
``postings``  (word, row, pos), by hash of the word in folders, sorted by word
``words``     (word, rows): how many rows hold a word, sorted by word

A search looks up how frequent its words are, joins the postings of the rarest one first,
finds phrases by adjacent positions and exclusions by an anti-join, and reads no text.
Rows are told apart by their number, so null and repeated ids are rows like any other.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fold_term, words
from .search import MAX_QUERY, TextQuery

FOLDERS = 64


def _folder(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(FOLDERS)).cast("int")


def write_text_index(df: DataFrame, path: str, column: str = "raw_message") -> None:
    """Append the rows of ``df`` to an index of their column ``column``.

    Postings of a frequent word may lie in several files. Appending writes a new segment
    and leaves the others alone.
    """
    spark = df.sparkSession
    segment = f"segment={uuid.uuid4().hex}"
    rows = df.withColumn("_words", F.size(words(F.col(column)))).withColumn("_row", F.monotonically_increasing_id())
    rows.write.parquet(f"{path}/rows/{segment}")
    # From the stored rows, whose numbers no longer change.
    stored = spark.read.parquet(f"{path}/rows/{segment}").select("_row", words(F.col(column)).alias("w"))
    postings = stored.select(F.posexplode("w").alias("pos", "word"), F.col("_row").alias("row"))
    (
        postings.withColumn("folder", _folder(F.col("word")))
        .hint("rebalance", "folder")
        .sortWithinPartitions("folder", "word", "row", "pos")
        .write.partitionBy("folder")
        .parquet(f"{path}/postings/{segment}")
    )
    (
        stored.select(F.explode(F.array_distinct("w")).alias("word"))
        .groupBy("word")
        .agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("folder", _folder(F.col("word")))
        .repartition("folder")
        .sortWithinPartitions("folder", "word")
        .write.partitionBy("folder")
        .parquet(f"{path}/words/{segment}")
    )


def word_rows(spark: SparkSession, path: str, wanted: Sequence[str]) -> dict[str, int]:
    """How many rows hold each of a few words."""
    asked = list(dict.fromkeys(wanted))
    if not asked:
        return {}
    # The folders are worked out here, so that the scan is pruned to them.
    known = spark.read.parquet(f"{path}/words").filter(_is_one_of(asked))
    counted = known.groupBy("word").agg(F.sum("rows").alias("rows")).collect()
    return {**dict.fromkeys(asked, 0), **{r["word"]: r["rows"] for r in counted}}


def _is_one_of(asked: Sequence[str]) -> Column:
    return reduce(Column.__or__, [(F.col("folder") == _folder(F.lit(w))) & (F.col("word") == w) for w in asked])


def text_index_search(spark: SparkSession, path: str, query: TextQuery) -> DataFrame:
    """The indexed rows that match, as :func:`search.text_search` finds them."""
    if len(query.text()) > MAX_QUERY:
        raise ValueError("query is too long")
    postings = spark.read.parquet(f"{path}/postings")
    key = ["segment", "row"]

    def all_terms(terms: Sequence[str]) -> list[list[str]]:
        return [folded for t in terms if (folded := fold_term(t))]

    must = all_terms([*query.all_of, query.phrase or ""])
    some, without = all_terms(query.any_of), all_terms(query.none_of)
    prefix = fold_term(query.prefix or "")
    frequency = word_rows(spark, path, [w for t in (*must, *some, *without, prefix[:-1]) for w in t])

    def holding(term: list[str], open_end: bool = False) -> DataFrame:
        """Rows with these words one after the other, the rarest looked up first; the last may go on."""

        def rare(k: int) -> tuple[bool, int]:
            return (open_end and k == len(term) - 1, frequency.get(term[k], 0))

        found = None
        for k in sorted(range(len(term)), key=rare):
            last = open_end and k == len(term) - 1
            here = postings.filter(F.col("word").startswith(term[k]) if last else _is_one_of([term[k]]))
            here = here.select(*key, (F.col("pos") - k).alias("start"))
            found = here if found is None else found.join(here, [*key, "start"], "left_semi")
        return found.select(*key)

    def rarest(term: list[str]) -> int:
        return min(frequency[w] for w in term)

    parts = [holding(t) for t in sorted(must, key=rarest)]
    if some:
        parts.append(reduce(DataFrame.unionByName, [holding(t) for t in some]))
    if prefix:
        parts.append(holding(prefix, open_end=True))
    rows = spark.read.parquet(f"{path}/rows")
    if not parts and not without:
        return rows.drop("segment", "_row", "_words")
    if parts:
        met = reduce(lambda left, right: left.join(right, key, "left_semi"), parts)
    else:
        # A row without a text matches nothing, not even the lack of a word.
        met = rows.filter(F.col("_words").isNotNull() & (F.col("_words") >= 0)).select("segment", F.col("_row").alias("row"))
    for term in without:
        met = met.join(holding(term), key, "left_anti")
    hits = met.withColumnRenamed("row", "_row")
    return rows.join(hits, ["segment", "_row"], "left_semi").drop("segment", "_row", "_words")
