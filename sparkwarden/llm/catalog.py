"""Registered queries of the operators: whole tables in, the contract's digest columns out."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest_neighbours
from .bpe import round_trip_digests
from .counts import token_counts
from .langid import held_out, identified
from .merkle import verified_rows
from .packing import packed_documents
from .quality import judged_documents
from .runs import run_digests
from .sharding import interleaved_shards
from .simhash import near_duplicates
from .tables import read_table
from .template import main_texts
from .topk import exact_top_k
from .warc import archived_pages


def posting_list_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = judged_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select(
        "row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = archived_pages(read_table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def rank_queue_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return round_trip_digests(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def best_two_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packed_documents(read_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def byte_gru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = identified(read_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return labelled.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def template_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(read_table(spark, sf_dir, "pages"))


def proportional_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleaved_shards(read_table(spark, sf_dir, "documents"), shards=24)


def columnar_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def word_run_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(read_table(spark, sf_dir, "documents"))


def merkle_witnesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_rows(read_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_posting_list_search": posting_list_search,
    "op2_quality_rules": quality_rules,
    "op3_simhash_components": simhash_components,
    "op4_seekable_warc": seekable_warc,
    "op5_template_main_text": template_main_text,
    "op6_rank_queue_bpe": rank_queue_bpe,
    "op7_byte_gru_language": byte_gru_language,
    "op8_proportional_shards": proportional_shards,
    "op9_best_two_fit": best_two_fit,
    "op10_prefix_token_counts": prefix_token_counts,
    "op11_columnar_top_k": columnar_top_k,
    "op12_word_runs": word_run_digests,
    "op13_merkle_witnesses": merkle_witnesses,
}
