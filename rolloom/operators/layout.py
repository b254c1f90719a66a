"""A layout of rollouts in which advantages meet their texts without moving them.

Texts and advantages are written as two tables with the same buckets, by the rollout's keys. A text is
shuffled once, when it is written; every later pass over the tokens joins bucket by bucket, builds a
hash table of the slim side and streams the texts: no exchange and no sort below the tokens.

Buckets hash keys that cannot be NULL: an empty value and a bit stand for a NULL. Rollouts that repeat
their keys above ``rows_per_task`` are dealt over several parts, with their advantage in each of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.operators.credit import ROLLOUT, one_per_rollout
from rolloom.operators.skew import ROWS_PER_TASK
from rolloom.session import materialize, remove


def _null_free(df: DataFrame, keys: Sequence[str]) -> dict[str, Column]:
    """Columns that are equal where the keys are, NULL or not, and never NULL themselves."""
    columns: dict[str, Column] = {}
    nulls = F.lit(0)
    for i, key in enumerate(keys):
        kind = df.schema[key].dataType
        empty = F.lit("") if isinstance(kind, T.StringType) else F.lit(0)
        columns[f"_k{i}"] = F.coalesce(F.col(key), empty.cast(kind))
        nulls = nulls + F.when(F.col(key).isNull(), F.lit(1 << i)).otherwise(F.lit(0))
    columns["_nulls"] = nulls
    return columns


def _names(name: str) -> tuple[str, str]:
    return f"{name}_texts", f"{name}_advantages"


def write_layout(
    texts: DataFrame,
    rollouts: DataFrame,
    name: str,
    path: str,
    keys: Sequence[str] = ROLLOUT,
    buckets: int | None = None,
    spread_by: Sequence[str] | None = None,
    rows_per_task: int = ROWS_PER_TASK,
) -> None:
    """Write ``texts`` and the advantages of ``rollouts`` as tables ``name_texts``, ``name_advantages``.

    The files lie below ``path``. ``buckets`` (default: the session's shuffle partitions) bounds the
    tasks of every later pass; choose it so that a bucket of texts suits one task. ``spread_by`` names
    the columns that deal out the texts of a repeated rollout (default: all that are no keys). The list
    of such rollouts has at most rows / ``rows_per_task`` entries, which bounds its broadcast.
    """
    spark = texts.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = texts.withColumns(_null_free(texts, keys))
    single = one_per_rollout(rollouts, keys)
    single = single.withColumns(_null_free(single, keys)).drop(*keys)
    at = [*[f"_k{i}" for i in range(len(keys))], "_nulls"]
    counts = keyed.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_per_task)
    hot = counts.select(*at, F.ceil(F.col("_n") / F.lit(rows_per_task)).cast("int").alias("_parts"))
    hot = materialize(hot, "repeated-rollouts")
    parts = F.coalesce("_parts", F.lit(1))
    spread = F.xxhash64(*(spread_by or [c for c in texts.columns if c not in keys] or keys))
    keyed = keyed.join(F.broadcast(hot), at, "left").withColumn(
        "_part", F.pmod(spread, parts).cast("int")
    )
    single = single.join(F.broadcast(hot), at, "left").withColumn(
        "_part", F.explode(F.sequence(F.lit(0), parts - 1))
    )
    place = [*at, "_part"]
    for table, rows, folder in zip(_names(name), (keyed, single), ("texts", "advantages")):
        rows = rows.drop("_parts").repartition(buckets, *place)
        writer = rows.write.bucketBy(buckets, *place).option("path", f"{path}/{folder}")
        writer.mode("overwrite").saveAsTable(table)


def read_layout(spark: SparkSession, name: str) -> DataFrame:
    """The texts with their ``advantage``, as :func:`rolloom.operators.credit.with_advantage` gives
    them; buckets meet buckets."""
    texts, advantages = map(spark.table, _names(name))
    place = [c for c in advantages.columns if c != "advantage"]
    # a hash table of the slim side: a sort-merge join would sort the texts of each bucket
    return texts.join(advantages.hint("shuffle_hash"), place).drop(*place)


def drop_layout(spark: SparkSession, name: str, path: str) -> None:
    for table in _names(name):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    remove(spark, path)
