"""Dataset from landed responses.

spark-submit examples/build_dataset.py LANDING OUT [TARGET]

LANDING holds JSON lines (batch_no, provider, status, raw). OUT/all receives every parsed row as
JSON lines, OUT/dataset the whole batches up to TARGET rows as JSON arrays.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloom.operators.dataset import collect_until  # noqa: E402
from rolloom.session import materialize  # noqa: E402
from rolloom.sources.qa import write_qa_json, write_qa_json_array  # noqa: E402
from rolloom.sources.responses import RESPONSE_SCHEMA  # noqa: E402
from rolloom.streaming.ingest import parse_responses  # noqa: E402


def main(landing: str, out: str, target: int = 100) -> None:
    spark = SparkSession.builder.appName("build-dataset").getOrCreate()
    rows = parse_responses(spark.read.schema(RESPONSE_SCHEMA).json(landing))
    rows = materialize(rows, "parsed")
    write_qa_json(rows.select("prompt", "answer"), f"{out}/all")
    write_qa_json_array(collect_until(rows.filter("is_object"), target), f"{out}/dataset")


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2], *map(int, sys.argv[3:4]))
