"""Evaluation results as JSON documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_SCHEMA = "task string, results struct<n:bigint, score:double, stderr:double>"


def write_eval_json(results: DataFrame, path: str) -> None:
    """Overwrite ``path`` with one document per task: ``{"task", "results": {...}}``."""
    document = F.struct("task", F.struct("n", "score", "stderr").alias("results"))
    results.select(F.to_json(document, {"ignoreNullFields": "false"}).alias("value")).write.mode(
        "overwrite"
    ).text(path)


def read_eval_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RESULT_SCHEMA).json(path)
    return rows.select("task", "results.n", "results.score", "results.stderr")
