"""From raw documents to token ids: language, exact copies, near copies, mix, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a frame; it is written and read again before the
next. All but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.llm.exact_dedup import drop_exact_copies
from rolloom.llm.language_id import tag_language
from rolloom.llm.mixing import draw_mix
from rolloom.llm.queries import PIECE_MODEL
from rolloom.llm.sentencepiece_codec import encode_texts
from rolloom.llm.simhash import keep_one_of_each_group
from rolloom.session import remove, remove_at_release, scratch_path, temporary_tables


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter go; ``lang`` becomes the language identified, up to the result."""
    return tag_language(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks the longest stays."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group one document stays, that with the smallest id."""
    return keep_one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return draw_mix(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, with its language and without its text."""
    slim = docs.select("doc_id", "source", "lang", "text")
    return encode_texts(slim, PIECE_MODEL, keep_text=False).select(
        "doc_id", "source", "lang", F.size("ids").cast("bigint").alias("n_tokens"), "ids"
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", language_id),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("mixing sources to target weights", mixing),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage writes for itself, and its input, go when its result is written."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with temporary_tables(spark):
            rows = stage(spark, docs, sf_dir)
            rows.write.parquet(path)
        remove_at_release(path)
        if written is not None:
            remove(spark, written)
        docs, written = spark.read.schema(rows.schema).parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)


# suffix automata, XXH64 fingerprints and sub-word ids are beyond SQL; see tests/llm/test_pipeline.py
ORACLE_SQL: str | None = None
