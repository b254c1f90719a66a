"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from rolloom.llm.embedding_dedup import embedding_groups
from rolloom.llm.exact_dedup import exact_dedup
from rolloom.llm.html_text import extract_text
from rolloom.llm.language_id import identify_documents
from rolloom.llm.merkle import merkle_manifest, without_line_feeds
from rolloom.llm.mixing import mix
from rolloom.llm.resampling import resample
from rolloom.llm.sentencepiece_codec import round_trip
from rolloom.llm.simhash import simhash_groups
from rolloom.llm.token_blocks import read_token_blocks, write_token_blocks
from rolloom.llm.token_counts import count_tokens
from rolloom.llm.topk_search import top_k
from rolloom.llm.warc import read_warc, write_warc
from rolloom.session import scratch_path

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
END_ID = 2


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(_table(spark, sf_dir, "documents"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"), digest_all=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    manifest = write_warc(_table(spark, sf_dir, "pages"), folder)
    return read_warc(manifest, folder).withColumnRenamed("key", "page_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(_table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(_table(spark, sf_dir, "documents"))


def op9_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-blocks")
    documents = _table(spark, sf_dir, "documents")
    manifest = write_token_blocks(documents, folder, BYTE_TOKENIZER, END_ID)
    return read_token_blocks(manifest, folder).withColumnRenamed("key", "doc_id")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "documents"), PIECE_MODEL)


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return merkle_manifest(documents, presented=without_line_feeds()).drop("steps")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_simhash,
        op2_exact_dedup,
        op3_warc,
        op4_token_counts,
        op5_html_text,
        op6_embedding_dedup,
        op7_mixing,
        op8_language_id,
        op9_token_blocks,
        op10_sentencepiece,
        op11_merkle,
        op12_resampling,
        op13_topk_search,
    )
}
