"""Question/answer datasets: JSON-array files and split trees."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

QA_SCHEMA = StructType(
    [StructField("prompt", StringType()), StructField("answer", StringType())]
)


def read_qa_json(spark: SparkSession, path: str | list[str], split: str) -> DataFrame:
    """Files that each hold one JSON array of ``{"prompt", "answer"}`` objects.

    The schema is fixed: answers of any JSON type arrive as text. An array file cannot be split, so
    the parallelism is the number of files; convert to Parquet for repeated use.
    """
    rows = spark.read.schema(QA_SCHEMA).option("multiLine", True).json(path)
    return rows.withColumn("split", F.lit(split))


def _array_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JSON objects of one file to the lines of a JSON array, batch by batch."""
    opened = False
    for batch in batches:
        rows = batch.column(0)
        if len(rows) == 0:
            continue
        if opened:
            lines = pc.binary_join_element_wise(",", rows, "")
        else:
            head = pa.array(["[" + rows[0].as_py()])
            lines = pa.concat_arrays(
                [head, pc.binary_join_element_wise(",", rows.slice(1), "").cast(pa.string())]
            )
            opened = True
        yield pa.RecordBatch.from_arrays([lines.cast(pa.string())], ["value"])
    yield pa.RecordBatch.from_arrays([pa.array(["]" if opened else "[]"])], ["value"])


def write_qa_json_array(qa: DataFrame, path: str) -> None:
    """Overwrite ``path`` with JSON-array files, one per partition.

    The rows of a partition stream through; brackets and commas are added on the way.
    """
    objects = qa.select(
        F.to_json(F.struct("prompt", "answer"), {"ignoreNullFields": "false"}).alias("value")
    )
    files = objects.mapInArrow(_array_lines, "value string").write.mode("overwrite")
    files.option("maxRecordsPerFile", 0).text(path)  # a file must hold its partition whole


def write_qa_json(qa: DataFrame, path: str) -> None:
    """Overwrite ``path`` with JSON lines, the splittable form of the dataset.

    One write for the whole dataset; incremental growth is the streaming ingest's job.
    """
    qa.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def read_qa_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QA_SCHEMA).json(path)


def write_split_tree(df: DataFrame, path: str) -> None:
    """Parquet tree partitioned by ``config`` and ``split``."""
    df.write.mode("overwrite").partitionBy("config", "split").parquet(path)


def read_split(spark: SparkSession, path: str, config: str, split: str) -> DataFrame:
    """One split of a named configuration; other partitions are pruned, not read."""
    tree = spark.read.parquet(path)
    return tree.filter((F.col("config") == config) & (F.col("split") == split))
