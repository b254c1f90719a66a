"""Responses arrive one file at a time; each is parsed and its rows are appended."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolloom.operators.dataset import explode_items, parse_batches
from rolloom.sources.responses import RESPONSE_SCHEMA, is_accepted, split_by_status, unwrap_response
from rolloom.streaming.committed import committed_folders

_SPLIT = (
    "batch_no bigint, status int, raw string, pos bigint, prompt string, answer string, "
    "is_object boolean, accepted boolean"
)


def parse_responses(responses: DataFrame, fenced: Column | None = None) -> DataFrame:
    """Raw responses to ``(batch_no, pos, prompt, answer, is_object)``; batch and stream alike.

    ``fenced`` limits fence stripping to some rows, e.g. to providers without a JSON mode.
    """
    accepted, _ = split_by_status(responses)
    return explode_items(parse_batches(unwrap_response(accepted), fenced=fenced))


def stream_ingest(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    fenced: Column | None = None,
) -> None:
    """Process everything that has landed since the last call and append it to ``out``.

    Responses with an HTTP error are left where they landed; :func:`stream_split` keeps them, too.

    Stateless: no watermark, nothing kept between files. The checkpoint makes a restart continue
    where the last run stopped; the file sink commits each micro-batch once.
    """
    query = (
        parse_responses(_landed(spark, landing, files_per_batch), fenced)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def _landed(spark: SparkSession, landing: str, files_per_batch: int) -> DataFrame:
    reader = spark.readStream.schema(RESPONSE_SCHEMA)
    return reader.option("maxFilesPerTrigger", files_per_batch).json(landing)


def split_responses(responses: DataFrame, fenced: Column | None = None) -> DataFrame:
    """Items of accepted responses and one row per rejected one, in a single pass over the responses.

    A rejected response keeps its ``status`` and ``raw`` text; it stands for one item without content,
    so that one explode serves both kinds.
    """
    marked = responses.withColumn("accepted", is_accepted())
    parsed = parse_batches(unwrap_response(marked), fenced=fenced)
    items = F.when(F.col("accepted"), F.col("items")).otherwise(
        F.array(F.lit(None).cast("string"))
    )
    kept = {"items": items, "raw": F.when(~F.col("accepted"), F.col("raw"))}
    return explode_items(parsed.withColumns(kept), carry=["accepted", "status", "raw"])


def stream_split(
    spark: SparkSession,
    landing: str,
    out: str,
    checkpoint: str,
    files_per_batch: int = 1000,
    fenced: Column | None = None,
) -> None:
    """Items and rejected responses of all that has landed since the last call, from one scan.

    A micro-batch is one write into a folder named by its number, with a partition for each of the two
    kinds. Spark commits it as a whole: a batch that broke off is written again over its remains, so
    items and rejected responses always tell of the same responses. :func:`read_split` reads both.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = split_responses(batch, fenced)
        folder = f"{out}/batch={batch_id}"
        rows.write.mode("overwrite").partitionBy("accepted").parquet(folder)

    query = (
        _landed(spark, landing, files_per_batch)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_split(spark: SparkSession, out: str) -> tuple[DataFrame, DataFrame]:
    """Items, and rejected responses ``(batch_no, status, raw)``, of the committed micro-batches."""
    folders = [f"{out}/{name}" for name in committed_folders(spark, out)]
    if folders:
        rows = spark.read.schema(_SPLIT).option("basePath", out).parquet(*folders)
    else:
        rows = spark.createDataFrame([], _SPLIT)
    items = rows.filter("accepted").select("batch_no", "pos", "prompt", "answer", "is_object")
    return items, rows.filter("NOT accepted").select("batch_no", "status", "raw")
