"""Group statistics, joins and running sums that stay whole when one key holds most rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_TASK = 1_000_000


def join_group_stats(
    rows: DataFrame,
    stats: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    count_col: str,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Attach the one ``stats`` row of a group to all of its rows.

    ``stats`` was pre-aggregated (map-side combine), so only the way back can be skewed. Groups
    above ``rows_per_task`` are cut into parts: their rows carry a part number taken from
    ``spread_by``, their stats row is repeated once per part. The list of cut groups has at most
    total_rows / rows_per_task entries, which bounds the broadcast.
    """
    keys = list(keys)
    parts = F.ceil(F.col(count_col) / F.lit(rows_per_task)).cast("int")
    named = stats.withColumnsRenamed({k: f"_stats_{k}" for k in keys})
    same_key = [F.col(k).eqNullSafe(F.col(f"_stats_{k}")) for k in keys]  # NULL is a group, too
    stats_keys = [f"_stats_{k}" for k in keys]

    hot = named.filter(F.col(count_col) > rows_per_task).select(*stats_keys, parts.alias("_parts"))
    part = F.pmod(F.xxhash64(*spread_by), F.coalesce("_parts", F.lit(1))).cast("int")
    cut_rows = (
        rows.join(F.broadcast(hot), same_key, "left")
        .withColumn("_part", part)
        .drop("_parts", *stats_keys)
    )
    repeated = named.withColumn(
        "_stats_part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1))
    )
    same_part = F.col("_part") == F.col("_stats_part")
    return cut_rows.join(repeated, [*same_key, same_part]).drop("_part", "_stats_part", *stats_keys)


def running_sum(
    df: DataFrame, order_col: str, value: Column, out: str, bits: int = 21
) -> DataFrame:
    """``out`` = sum of ``value`` over all rows before this one in ``order_col`` order.

    ``order_col`` holds distinct integers; a NULL among them is an error, as it has no place in the
    order. A window without partitions would pull everything into one task, so the order is cut into
    ranges of 2**bits values: a window inside each range, plus the totals of the ranges before it,
    found the same way one and two levels up (3 x 21 bits span all of BIGINT but its sign). No window
    sees more than 2**bits rows.
    """
    missing = F.raise_error(F.lit(f"NULL in {order_col}, which gives the order")).cast("bigint")
    rows = df.withColumn(order_col, F.coalesce(F.col(order_col), missing))
    rows = rows.withColumn("_v", value.cast("bigint"))
    levels = -(-63 // bits)

    def before(order: str, *partition: str):
        window = Window.partitionBy(*partition).orderBy(order)
        return F.coalesce(
            F.sum("_v").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        )

    def at(level: int) -> Column:
        return F.shiftright(F.col(order_col), level * bits)

    # totals of the ranges, from fine to coarse; level 0 is the input itself
    tables = [rows.withColumn("_k0", F.col(order_col)).withColumn("_k1", at(1))]
    for level in range(1, levels):
        tables.append(
            tables[-1]
            .groupBy(f"_k{level}")
            .agg(F.sum("_v").alias("_v"))
            .withColumn(f"_k{level + 1}", F.shiftright(f"_k{level}", bits))
        )
    # on top there are two ranges, -1 and 0: all negative numbers come before the others
    top = f"_k{levels}"
    signs = tables[-1].groupBy(top).agg(F.sum("_v").alias("_base"))
    offsets = signs.withColumn(top, F.col(top) + 1)
    # offsets of the ranges, from coarse to fine
    for level in range(levels - 1, 0, -1):
        totals = tables[level].withColumn(
            "_own", before(f"_k{level}", f"_k{level + 1}")
        )
        totals = totals.join(offsets, f"_k{level + 1}", "left").withColumn(
            "_own", F.col("_own") + F.coalesce("_base", F.lit(0))
        )
        offsets = totals.select(f"_k{level}", F.col("_own").alias("_base"))
    own = tables[0].withColumn(out, before("_k0", "_k1"))
    return (
        own.join(offsets, "_k1")
        .withColumn(out, F.col(out) + F.col("_base"))
        .drop("_v", "_k0", "_k1", "_base")
    )
