"""Evaluation report of scored samples.

spark-submit examples/eval_report.py SAMPLES OUT [LIMIT]

SAMPLES: Parquet with task, sample_id, prompt, completion, answer. OUT receives one JSON document
per task; the table is printed.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloom.operators.reports import eval_rollup, eval_table, limit_per_task  # noqa: E402
from rolloom.operators.rewards import add_rewards  # noqa: E402
from rolloom.session import materialize  # noqa: E402
from rolloom.sources.reports import write_eval_json  # noqa: E402


def main(samples: str, out: str, limit: int | None = None) -> None:
    spark = SparkSession.builder.appName("eval-report").getOrCreate()
    rows = limit_per_task(spark.read.parquet(samples), "sample_id", limit)
    scored = add_rewards(rows, ["correct_exact2"])
    score = (F.col("r_correct_exact2") > 0).cast("double").alias("score")
    slim = materialize(scored.select("task", "sample_id", score), "samples")
    write_eval_json(eval_rollup(slim), out)
    eval_table(slim).show(truncate=False)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:4]))
