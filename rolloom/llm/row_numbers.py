"""Rows that are told apart whatever they hold, and their places in an order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.session import materialize

_ROW_BITS = 33  # monotonically_increasing_id: the partition above, the row in it below


def with_row_number(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written with a number of its own for each row, and the name of that column.

    A number that is not written may be another one in the next scan.
    """
    taken = {c.lower() for c in df.columns}
    row = "_row"
    while row in taken:
        row = "_" + row
    return materialize(df.withColumn(row, F.monotonically_increasing_id()), name), row


def with_positions(
    df: DataFrame, order: Sequence[Column | str], group: Sequence[str] = (), name: str = "ordered"
) -> DataFrame:
    """Adds to each row its place in the order of ``group`` and ``order``, without a window over rows.

    ``_at`` counts from 0 inside the row's group, ``_n`` is the size of the group and ``_start`` the
    place of its first row among all rows; NULL groups are one group. Rows are dealt by range of the
    whole order, so a large group lies in many tasks, and written once; what is summed up then has a
    row per task and group that the task holds. ``order`` should tell rows apart: rows that are equal
    in it come in any order, and in one task.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    rows = df.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    rows = materialize(rows.withColumn("_id", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_part", F.shiftright("_id", _ROW_BITS)).withColumn(
        "_in_part", F.col("_id").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    )
    counts = rows.groupBy("_part", *group).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_in_part").alias("_first")
    )
    # one row per task: the rows of all tasks before it
    sizes = counts.groupBy("_part").agg(F.sum("_rows").alias("_size"))
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(
        F.col("_part").alias("_p"), F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_base")
    )
    counts = counts.join(bases, F.col("_part") == F.col("_p"))
    inside = Window.partitionBy(*group)
    so_far = inside.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        F.col("_p"),
        *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
        (F.coalesce(F.sum("_rows").over(so_far), F.lit(0)) - F.col("_first")).alias("_shift"),
        F.sum("_rows").over(inside).alias("_n"),
        F.min(F.col("_base") + F.col("_first")).over(inside).alias("_start"),
    )
    same = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(group)]
    placed = rows.join(places, [F.col("_part") == F.col("_p"), *same])
    return placed.withColumn("_at", F.col("_in_part") + F.col("_shift")).drop(
        "_id", "_part", "_in_part", "_p", "_shift", *[f"_g{i}" for i in range(len(group))]
    )
