"""The step log while training runs.

Steps carry no event time, so a streaming aggregation could never drop its state. Each micro-batch
writes mergeable partial moments instead, and the report merges them: the stream keeps no state, and
a batch that is run again overwrites its own partials.

Closed batches are compacted. A folder holds the moments of a range of batch numbers; aligned ranges
of ``fan_in``, ``fan_in ** 2``, ... batches are folded into one as soon as a later batch has begun, so
a report reads about ``fan_in`` folders per level, not one per batch. A folder counts once Spark has
committed it, and a range inside a larger committed one no longer counts: the commit of the larger
range replaces all its parts at once, and whatever a crash left undone is done again by the next fold.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StructType

from rolloom.session import remove
from rolloom.streaming.committed import committed_folders

MEANS = {"loss": "loss", "completion_length": "completion_length", "kl": "logp - ref_logp"}
FAN_IN = 16
_FOLDER = re.compile(r"moments-(\d+)-(\d+)\Z")
Range = tuple[int, int]


def moments_schema(step: DataType) -> StructType:
    schema = StructType().add("step", step)
    for name in MEANS:
        schema = schema.add(f"{name}_n", LongType()).add(f"{name}_sum", DoubleType())
    return (
        schema.add("reward_n", LongType())
        .add("reward_mean", DoubleType())
        .add("reward_m2", DoubleType())
    )


def partial_moments(rollouts: DataFrame, every: int = 1) -> DataFrame:
    """Per step, mergeable: count and sum of each averaged column, count, mean and squared
    deviations of the reward. ``kl`` is NULL without ``logp`` and ``ref_logp``.

    Rows without a step are the step NULL; a cadence (``every`` above 1) leaves them out.
    """
    if every > 1:
        rollouts = rollouts.filter(F.pmod(F.col("step"), F.lit(every)) == 0)
    aggs = []
    for name, sql in MEANS.items():
        has = name != "kl" or {"logp", "ref_logp"} <= set(rollouts.columns)
        value = (F.expr(sql) if has else F.lit(None)).cast("double")
        aggs += [F.count(value).alias(f"{name}_n"), F.sum(value).alias(f"{name}_sum")]
    n = F.count("reward")
    return rollouts.groupBy("step").agg(
        *aggs,
        n.alias("reward_n"),
        F.avg("reward").alias("reward_mean"),
        (F.var_pop("reward") * n).alias("reward_m2"),
    )


def fold_moments(partials: DataFrame) -> DataFrame:
    """One row of moments per step from any number of them; the NULL step is a step like any other.

    The mean of a step is found first and joined back to its partials, whose own means are then
    taken from it: squares of differences add up without cancelling, however large the rewards are.
    """
    n, weighted = F.sum("reward_n"), F.sum(F.col("reward_n") * F.col("reward_mean"))
    means = partials.groupBy(F.col("step").alias("_step")).agg(
        (weighted / F.nullif(n, F.lit(0))).alias("_mean")
    )
    apart = F.col("reward_mean") - F.col("_mean")
    joined = partials.join(means, F.col("step").eqNullSafe(F.col("_step")))
    sums = [F.sum(f"{name}_{x}").alias(f"{name}_{x}") for name in MEANS for x in ("n", "sum")]
    return joined.groupBy("step").agg(
        *sums,
        n.alias("reward_n"),
        F.any_value("_mean").alias("reward_mean"),
        F.sum(F.col("reward_m2") + F.col("reward_n") * apart * apart).alias("reward_m2"),
    )


def merge_moments(partials: DataFrame) -> DataFrame:
    """Step log from partial moments."""
    folded, n = fold_moments(partials), F.col("reward_n")
    average = {name: F.col(f"{name}_sum") / F.nullif(f"{name}_n", F.lit(0)) for name in MEANS}
    return folded.select(
        "step",
        average["loss"].alias("loss"),
        F.col("reward_mean").alias("reward"),
        F.when(n > 1, F.sqrt(F.col("reward_m2") / (n - 1))).alias("reward_std"),
        average["completion_length"].alias("completion_length"),
        average["kl"].alias("kl"),
    )


def _folder(out: str, batches: Range) -> str:
    return f"{out}/moments-{batches[0]:019d}-{batches[1]:019d}"


def committed(spark: SparkSession, out: str) -> tuple[list[Range], list[Range]]:
    """The ranges of batches that count, in order, and those that a larger one has replaced."""
    names = map(_FOLDER.match, committed_folders(spark, out))
    found = [(int(name[1]), int(name[2])) for name in names if name]
    counts: list[Range] = []
    replaced: list[Range] = []
    reach = -1
    for first, last in sorted(found, key=lambda r: (r[0], -r[1])):
        if last <= reach:
            replaced.append((first, last))
        else:
            counts.append((first, last))
            reach = last
    return counts, replaced


def read_moments(spark: SparkSession, out: str, step: DataType | None = None) -> DataFrame:
    """The partial moments that count; none give no rows."""
    schema = moments_schema(step or LongType())
    counts, _ = committed(spark, out)
    if not counts:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[_folder(out, r) for r in counts])


def compact(
    spark: SparkSession,
    out: str,
    newest: int,
    fan_in: int = FAN_IN,
    step: DataType | None = None,
    clean: Callable[..., None] = remove,
) -> None:
    """Fold closed ranges: those that end before batch ``newest``, which alone may be run again.

    Safe to repeat at any point: a fold overwrites its own folder, counts once it is committed, and
    only then the folders it replaces are removed.
    """
    schema = moments_schema(step or LongType())
    wide = fan_in
    while wide <= newest:
        counts, _ = committed(spark, out)
        inside: dict[int, list[Range]] = {}
        for first, last in counts:
            start = first - first % wide
            if last < start + wide <= newest:
                inside.setdefault(start, []).append((first, last))
        for start, ranges in sorted(inside.items()):
            if len(ranges) > 1:
                parts = spark.read.schema(schema).parquet(*[_folder(out, r) for r in ranges])
                folded = _folder(out, (start, start + wide - 1))
                fold_moments(parts).write.mode("overwrite").parquet(folded)
        wide *= fan_in
    _, replaced = committed(spark, out)
    clean(spark, *[_folder(out, r) for r in replaced])


def stream_step_log(
    spark: SparkSession,
    source: str,
    schema: StructType,
    out: str,
    checkpoint: str,
    prepare,
    glob: str | None = None,
    every: int = 1,
    files_per_batch: int = 1000,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Fold all rows that have arrived at ``source`` into ``out``; returns the merged step log.

    ``prepare`` maps the source rows to ``(step, loss, reward, completion_length)``, and ``logp`` and
    ``ref_logp`` where there are any. ``every`` keeps the steps of the logging cadence. A batch that
    is run again overwrites its own moments; one that has been folded already is left alone.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    rows = prepare(reader.parquet(source))
    step = rows.schema["step"].dataType

    def fold(batch: DataFrame, batch_id: int) -> None:
        counts, _ = committed(spark, out)
        if any(first <= batch_id <= last and first < last for first, last in counts):
            return
        moments = partial_moments(batch, every)
        moments.write.mode("overwrite").parquet(_folder(out, (batch_id, batch_id)))
        compact(spark, out, batch_id, fan_in, step)

    query = (
        rows.writeStream.foreachBatch(fold)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return merge_moments(read_moments(spark, out, step))
