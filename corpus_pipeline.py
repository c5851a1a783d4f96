"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver of the
stages writes it as Parquet and hands it to the next one as `docs`.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sparkwarden.llm.langid import in_a_language
from sparkwarden.llm.packing import packed_documents
from sparkwarden.llm.quality import judged_documents
from sparkwarden.llm.simhash import one_of_each
from sparkwarden.llm.tables import read_table, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose language the network determines; it learns from the documents of this stage."""
    return in_a_language(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the counts and resemble the trusted ones; judged on the documents of this stage."""
    judged = judged_documents(docs, read_table(spark, sf_dir, "labels"))
    return judged.where("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences."""
    return packed_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("packing", packing),
]

#: The likelihood ratios hash words with XXH64 and the packing needs a tokenizer: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
