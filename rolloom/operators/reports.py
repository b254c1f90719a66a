"""Step reports and evaluation tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.constants import REPORT_EVERY
from rolloom.functions.numbers import fixed_text
from rolloom.operators.skew import join_group_stats
from rolloom.session import materialize


def accum_report(steps: DataFrame, every: int = REPORT_EVERY, mode: str = "last") -> DataFrame:
    """One line per optimizer update, from ``(step, loss, mean_reward)``.

    ``last`` reports the values of the step that closes the update; ``mean`` averages the steps of
    the update. The loss is shown un-scaled.
    """
    if mode == "last":
        shown = steps.filter(F.pmod(F.col("step") + 1, F.lit(every)) == 0).select(
            "step", "loss", "mean_reward"
        )
    elif mode == "mean":
        shown = (
            steps.groupBy(F.floor(F.col("step") / every).alias("_u"))
            .agg(
                F.max("step").alias("step"),
                F.avg("loss").alias("loss"),
                F.avg("mean_reward").alias("mean_reward"),
            )
            .filter(F.pmod(F.col("step") + 1, F.lit(every)) == 0)
            .drop("_u")
        )
    else:
        raise ValueError(f"mode {mode!r}")
    line = F.concat(
        F.lit("Step "),
        F.col("step").cast("string"),
        F.lit(": Loss="),
        fixed_text(F.col("loss"), 4),
        F.lit(", Mean Reward="),
        fixed_text(F.col("mean_reward"), 2),
    )
    return shown.withColumn("line", line)


def step_log(rollouts: DataFrame, every: int = 1) -> DataFrame:
    """Per step: loss, reward, reward_std, completion_length, kl.

    ``kl`` is the mean of ``logp - ref_logp`` where both columns exist, else NULL. Steps off the
    logging cadence are dropped before the aggregation.
    """
    if every > 1:
        rollouts = rollouts.filter(F.pmod(F.col("step"), F.lit(every)) == 0)
    has_ref = {"logp", "ref_logp"} <= set(rollouts.columns)
    kl = F.avg(F.col("logp") - F.col("ref_logp")) if has_ref else F.lit(None).cast("double")
    return rollouts.groupBy("step").agg(
        F.avg("loss").alias("loss"),
        F.avg("reward").alias("reward"),
        F.stddev_samp("reward").alias("reward_std"),
        F.avg("completion_length").alias("completion_length"),
        kl.alias("kl"),
    )


_DIGIT_BITS = 16
_DIGITS = 64 // _DIGIT_BITS


def _digits(value: Column) -> list[Column]:
    """A BIGINT as digits whose order is its own, NULL before all others."""
    top = F.shiftright(value, 64 - _DIGIT_BITS) + (1 << (_DIGIT_BITS - 1)) + 1
    rest = [
        F.shiftright(value, 64 - _DIGIT_BITS * (i + 1)).bitwiseAND(F.lit((1 << _DIGIT_BITS) - 1))
        for i in range(1, _DIGITS)
    ]
    return [F.coalesce(x, F.lit(0)).cast("int") for x in (top, *rest)]


def limit_per_task(
    samples: DataFrame, order_by: str, limit: int | None, tie: Sequence[str] | None = None
) -> DataFrame:
    """The first ``limit`` samples of each task in ``order_by`` order; None keeps all.

    NULL orders come first, and the NULL task is a task. Samples of one order go by a hash of the
    columns ``tie``, if given, then by one of all other columns; of equal samples any are kept.
    The order is an integer; other types are ranked, within parts of a task first.

    No sample is ranked: each task's limit is found as a threshold, digit by digit. A histogram of the
    next digit is counted map-side over the samples that share the digits before, so a task that holds
    most samples is counted by all tasks of Spark; windows see digits, at most 2**16 per task. Samples
    are then compared with the threshold of their task, which reaches a large task in parts.
    """
    if limit is None:
        return samples
    if limit < 1:
        return samples.filter(F.lit(False))
    others = [c for c in samples.columns if c not in ("task", order_by)]
    if not isinstance(samples.schema[order_by].dataType, T.IntegralType):
        return _ranked_in_parts(samples, order_by, limit, tie or others)
    digits = _digits(F.col(order_by).cast("bigint"))
    for columns in ([tie] if tie else []) + [others or [order_by]]:
        digits += _digits(F.xxhash64(*columns))
    names = [f"_d{i}" for i in range(len(digits))]
    marked = dict(zip(names, digits))
    slim = samples.select(F.col("task").alias("_task"), *[d.alias(n) for n, d in marked.items()])
    slim = materialize(slim, "limit-digits")  # read once per level
    totals = slim.groupBy("_task").agg(F.count(F.lit(1)).alias("_total"))
    totals = materialize(totals, "limit-totals")
    bounds = totals.filter(F.col("_total") > limit).select(
        F.col("_task").alias("_of"), F.lit(limit).cast("bigint").alias("_need")
    )
    path: list[str] = []
    for name in names:
        same = [F.col("_task").eqNullSafe(F.col("_of")), *[F.col(x) == F.col(f"{x}_of") for x in path]]
        inside = slim.join(bounds, same)
        held = ["_of", "_need", *[f"{x}_of" for x in path]]
        counts = inside.groupBy(*held, name).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(
            Window.partitionBy("_of").orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        )
        counts = counts.withColumn("_before", upto - F.col("_n"))
        edge = counts.filter(
            (F.col("_before") < F.col("_need")) & (F.col("_before") + F.col("_n") >= F.col("_need"))
        )
        path.append(name)
        bounds = materialize(
            edge.select(
                "_of", (F.col("_need") - F.col("_before")).alias("_need"), "_n",
                *[f"{x}_of" for x in path[:-1]], F.col(name).alias(f"{name}_of"),
            ),
            "limit-bounds",
        )
        if bounds.filter("_n > _need").isEmpty():
            break
    stats = totals.join(bounds, F.col("_task").eqNullSafe(F.col("_of")), "left").drop("_of")
    stats = stats.withColumnRenamed("_task", "task")
    rows = samples.withColumns({n: marked[n] for n in path})
    joined = join_group_stats(rows, stats, ["task"], path, "_total")
    here, there = F.struct(*path), F.struct(*[F.col(f"{x}_of").alias(x) for x in path])
    at_edge = F.coalesce(here == there, F.lit(False))
    below = joined.filter(F.col("_need").isNull() | (here < there) | (at_edge & (F.col("_n") <= F.col("_need"))))
    # equal in every digit: so many of them as are needed, counted and not ranked
    equal = joined.filter(at_edge & (F.col("_n") > F.col("_need")))
    equal = equal.groupBy(*samples.columns).agg(F.any_value("_need").alias("_need"))
    copies = equal.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), "_need")))
    return below.select(samples.columns).unionByName(copies.select(samples.columns))


def _ranked_in_parts(
    samples: DataFrame, order_by: str, limit: int, tie: Sequence[str], parts: int = 256
) -> DataFrame:
    order = [F.col(order_by), *([F.xxhash64(*tie)] if tie else [])]
    part = F.pmod(F.xxhash64(order_by, *tie), F.lit(parts))
    rank = F.row_number().over(Window.partitionBy("task", "_part").orderBy(*order))
    cut = samples.withColumn("_part", part).withColumn("_rank", rank).filter(F.col("_rank") <= limit)
    rank = F.row_number().over(Window.partitionBy("task").orderBy(*order))
    return cut.withColumn("_rank", rank).filter(F.col("_rank") <= limit).drop("_rank", "_part")


def _score_aggs():
    n = F.count(F.lit(1))
    return [
        n.alias("n"),
        F.avg("score").alias("score"),
        (F.stddev_samp("score") / F.sqrt(n)).alias("stderr"),
    ]


def eval_rollup(samples: DataFrame) -> DataFrame:
    """Per task: sample count, mean score, standard error of the mean."""
    return samples.groupBy("task").agg(*_score_aggs())


def eval_table(samples: DataFrame) -> DataFrame:
    """The results as text, one row per task in task order and one over all tasks."""
    rolled = samples.rollup("task").agg(F.grouping("task").alias("_all"), *_score_aggs())
    label = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col("task"))
    return rolled.orderBy("_all", "task").select(
        label.alias("task"),
        "n",
        fixed_text(F.col("score"), 4).alias("score"),
        F.concat(F.lit("± "), fixed_text(F.col("stderr"), 4)).alias("stderr"),
    )
