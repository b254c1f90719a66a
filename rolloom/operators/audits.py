"""Audits of datasets and rewards: what the generator asks for and the trainers rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.operators.rewards import (
    correct_contains1,
    correct_contains2,
    correct_exact2,
    correct_pm1,
)

# shapes of a "final numeric or short answer", tried in this order
_NUMBER = "[+-]?([0-9]{1,3}(,[0-9]{3})+|[0-9]+)"
ANSWER_SHAPES = {
    "integer": f"\\A{_NUMBER}\\z",
    "decimal": f"\\A{_NUMBER}?\\.[0-9]+\\z",
    "fraction": "\\A[+-]?[0-9]+ ?/ ?[0-9]+\\z",
    "money": f"\\A[+-]?[$] ?{_NUMBER}(\\.[0-9]+)?\\z",
    "with unit": f"\\A{_NUMBER}(\\.[0-9]+)? ?[^0-9\\n]+\\z",
}

# the four notions of a correct completion
CORRECT = {
    "contains_answer": correct_contains2,
    "exact": correct_exact2,
    "contains_text": correct_contains1,
    "contains_sequence": correct_pm1,
}


def normalised_text(text: Column) -> Column:
    """Lower case, runs of blanks as one blank, none at the ends."""
    return F.btrim(F.regexp_replace(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+", " "))


def text_digest(text: Column) -> Column:
    """A short key for the normalised text, so that long texts are not shuffled."""
    return F.sha2(normalised_text(text), 256)


def answer_in_prompt(qa: DataFrame, *by: str) -> DataFrame:
    """Rows, and rows whose prompt already holds the answer, per group; NULLs hold nothing."""
    leaked = F.coalesce(F.contains("prompt", "answer"), F.lit(False))
    n, n_leaked = F.count(F.lit(1)), F.count_if(leaked)
    return qa.groupBy(*by).agg(
        n.alias("n"), n_leaked.alias("n_in_prompt"), (n_leaked / n).alias("rate")
    )


def split_overlap(
    test: DataFrame, train: DataFrame, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Rows of ``test`` whose normalised text is in ``train``, and the clean rest.

    A semi and an anti join on digests; a NULL text is in neither split twice and counts as clean.
    """
    keys = train.select(text_digest(F.col(text)).alias("_digest"))
    marked = test.withColumn("_digest", text_digest(F.col(text)))
    return (
        marked.join(keys, "_digest", "left_semi").drop("_digest"),
        marked.join(keys, "_digest", "left_anti").drop("_digest"),
    )


def repeated_texts(rows: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Texts that occur more than once when normalised: digest, number, first key."""
    counted = rows.filter(F.col(text).isNotNull()).groupBy(
        text_digest(F.col(text)).alias("digest")
    )
    return counted.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first_key")).filter("n > 1")


def answer_shape(answer: Column) -> Column:
    """Which shape an answer has; ``other`` for none of them, NULL for NULL."""
    trimmed = F.btrim(answer)
    shape = F.lit("other")
    for name, pattern in reversed(ANSWER_SHAPES.items()):
        shape = F.when(F.rlike(trimmed, F.lit(pattern)), F.lit(name)).otherwise(shape)
    return F.when(answer.isNotNull(), shape)


def answer_shapes(rows: DataFrame, answer: Column) -> DataFrame:
    """Rows per shape of answer."""
    return rows.groupBy(answer_shape(answer).alias("shape")).agg(F.count(F.lit(1)).alias("n"))


def reward_gap(rollouts: DataFrame) -> DataFrame:
    """Rollouts per combination of the four notions of correct."""
    inputs = {name: F.col(name) for name in rollouts.columns}
    judged = rollouts.select(
        *[(rule(inputs) > 0).alias(name) for name, rule in CORRECT.items()]
    )
    return judged.groupBy(*CORRECT).agg(F.count(F.lit(1)).alias("n"))
