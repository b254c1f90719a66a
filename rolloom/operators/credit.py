"""Advantages, token credit and the masked loss."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.constants import ADVANTAGE_EPS, HICRA_ALPHA
from rolloom.operators.skew import ROWS_PER_TASK, join_group_stats

ROLLOUT = ["prompt_id", "gen_idx"]


def group_stats(rollouts: DataFrame, key: str = "prompt_id", reward: str = "reward") -> DataFrame:
    """Mean, sample standard deviation and size per rollout group, combined map-side."""
    return rollouts.groupBy(key).agg(
        F.avg(reward).alias("mean_reward"),
        F.stddev_samp(reward).alias("std_reward"),
        F.count(F.lit(1)).alias("n_rollouts"),
    )


def normalised(reward: Column, mean: Column, std: Column, eps: float = ADVANTAGE_EPS) -> Column:
    """``(r - mean) / (std + eps)``; NULL in a group of one, where the deviation is undefined."""
    return (reward - mean) / (std + F.lit(eps))


def group_advantage(
    rollouts: DataFrame,
    key: str = "prompt_id",
    index: str = "gen_idx",
    reward: str = "reward",
    eps: float = ADVANTAGE_EPS,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Add ``advantage``: the reward normalised within its group.

    Statistics are pre-aggregated and joined back, with large groups cut into parts, so one prompt
    may hold any share of the rollouts. Pass the slim score columns, not the texts: the input is
    read once for the statistics and once for the join.
    """
    stats = group_stats(rollouts, key, reward)
    joined = join_group_stats(rollouts, stats, [key], [index], "n_rollouts", rows_per_task)
    advantage = normalised(F.col(reward), F.col("mean_reward"), F.col("std_reward"), eps)
    return joined.withColumn("advantage", advantage).drop(
        "mean_reward", "std_reward", "n_rollouts"
    )


def one_per_rollout(rollouts: DataFrame, keys: Sequence[str] = ROLLOUT) -> DataFrame:
    """``(keys, advantage)`` once per rollout, NULL keys included.

    Rows that repeat a rollout's keys are taken for copies of it; where their advantages differ, the
    smallest counts.
    """
    return rollouts.groupBy(*keys).agg(F.min("advantage").alias("advantage"))


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on ``keys`` in which NULL meets NULL; the keys are there once."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(named, same).drop(*[f"_right_{k}" for k in keys])


def token_advantage(
    tokens: DataFrame, rollouts: DataFrame, keys: Sequence[str] = ROLLOUT
) -> DataFrame:
    """Spread the advantage of a rollout to all of its tokens, for tables that arrive as tokens.

    Where the texts are at hand, :func:`with_advantage` first and tokens after it is the way: then
    the join moves rollouts, not tokens. Keys as there.
    """
    return join_on(tokens, one_per_rollout(rollouts, keys), keys)


def with_advantage(
    texts: DataFrame, rollouts: DataFrame, keys: Sequence[str] = ROLLOUT
) -> DataFrame:
    """Add a rollout's ``advantage`` to its text row, before it is cut into tokens.

    NULL keys are keys like any other. Every text stays one row, also where rollouts repeat
    (:func:`one_per_rollout`); a text without a rollout drops. The texts are shuffled for this; in the
    layout of :mod:`rolloom.operators.layout` they stay where they are.
    """
    return join_on(texts, one_per_rollout(rollouts, keys), keys)


def hicra_advantage(advantage: Column, planning: Column, alpha: float = HICRA_ALPHA) -> Column:
    """``A + alpha * |A|`` on planning tokens: gains grow, losses soften."""
    return advantage + F.lit(alpha) * F.abs(advantage) * planning.cast("double")


def token_logprob(logits: Column, label: Column) -> Column:
    """Log-softmax of ``logits`` at the 0-based ``label``; NULL if the label is out of range."""
    values = F.transform(logits, lambda x: x.cast("double"))
    top = F.array_max(values)
    mass = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
    return F.get(values, label) - top - F.ln(mass)


LOGIT_BAND = 300.0  # exp of twice this is still a double


def token_logprob_rows(
    logits: DataFrame,
    keys: Sequence[str],
    token: str = "token_id",
    logit: str = "logit",
    label: str = "label",
) -> DataFrame:
    """:func:`token_logprob` of logits that come as rows, e.g. in shards of the vocabulary.

    One row per position (``keys``) and token, with the position's label in each. A log-sum-exp is
    merged from pairs of a maximum and a sum scaled by it: logits are summed in bands of LOGIT_BAND,
    each scaled by the band's lower end, map-side, so a shuffle carries a row or two per position and
    task, however large the vocabulary. Of a position's bands the two highest decide; what lies below
    is smaller than a double can tell.

    ``(keys, logp)``: NULL where the label is NULL or has no row. NULL logits are left out; minus
    infinity adds nothing. NULL keys are keys like any other.
    """
    band = F.floor(F.col(logit).cast("double") / F.lit(LOGIT_BAND)).cast("double")
    never = F.col(logit) == F.lit(float("-inf"))
    rows = logits.filter(F.col(logit).isNotNull()).withColumn(
        "_band", F.when(never, F.lit(float("-inf"))).otherwise(band)
    )
    scaled = F.exp(F.col(logit).cast("double") - F.col("_band") * F.lit(LOGIT_BAND))
    bands = rows.groupBy(*keys, "_band").agg(
        F.sum(F.when(never, F.lit(0.0)).otherwise(scaled)).alias("_mass"),
        F.max(F.when(F.col(token) == F.col(label), F.col(logit).cast("double"))).alias("_own"),
    )
    # a few rows per position from here on
    top = F.max("_band").over(Window.partitionBy(*keys))
    bands = bands.withColumn("_top", top)
    down = F.exp((F.col("_band") - F.col("_top")) * F.lit(LOGIT_BAND))
    share = F.when(F.col("_band") == F.col("_top"), F.col("_mass")).otherwise(F.col("_mass") * down)
    return bands.groupBy(*keys).agg(
        (
            F.max("_own") - F.max("_top") * F.lit(LOGIT_BAND) - F.ln(F.sum(share))
        ).alias("logp")
    )


def shift_labels(tokens: DataFrame) -> DataFrame:
    """Position j predicts token j + 1: ``shifted_idx`` = token index - 1, the first token drops.

    The shift is a change of key, so neither a window nor a shuffle is needed.
    """
    return tokens.filter(F.col("token_idx") >= 1).withColumn(
        "shifted_idx", F.col("token_idx") - 1
    )


def completion_mask(shifted_idx: Column, prompt_len: Column, compat: bool = True) -> Column:
    """1.0 on completion positions, 0.0 on the prompt.

    ``compat`` masks by the un-shifted prompt length, which also drops the first completion token;
    ``compat=False`` counts it.
    """
    first = prompt_len if compat else prompt_len - 1
    return (shifted_idx >= first).cast("double")


def align_min_len(
    advantages: DataFrame, logprobs: DataFrame, keys: Sequence[str] = ROLLOUT
) -> DataFrame:
    """Cut two position-wise tables to their common positions, for tables that arrive as tokens.

    Lists in one row are cut by :func:`align_lists`, without a join of tokens. NULL keys are keys like
    any other. Every row of ``advantages`` stays one row: of rows in ``logprobs`` that repeat a
    position the smallest counts, by its columns from left to right.
    """
    place = [*keys, "shifted_idx"]
    rest = [c for c in logprobs.columns if c not in place]
    single = logprobs.groupBy(*place).agg(F.min(F.struct(*rest)).alias("_rest"))
    return join_on(advantages, single.select(*place, "_rest.*"), place)


def align_lists(rows: DataFrame, keys: Sequence[str], **lists: Column) -> DataFrame:
    """Lists of one rollout, cut to the shortest and laid side by side: ``(keys, shifted_idx, ...)``.

    The first position drops, as in :func:`shift_labels`. Nothing is shuffled.
    """
    named = rows.select(*keys, *[value.alias(f"_{name}") for name, value in lists.items()])
    sizes = [F.coalesce(F.size(f"_{name}"), F.lit(0)) for name in lists]
    shortest = F.least(*sizes) if len(sizes) > 1 else sizes[0]
    named = named.withColumn("_n", F.greatest(shortest - 1, F.lit(0)))
    cut = [F.slice(f"_{name}", F.lit(2), F.col("_n")).alias(name) for name in lists]
    pairs = named.select(*keys, F.posexplode_outer(F.arrays_zip(*cut)).alias("shifted_idx", "_p"))
    return pairs.filter(F.col("shifted_idx").isNotNull()).select(
        *keys, F.col("shifted_idx").cast("bigint").alias("shifted_idx"), "_p.*"
    )


def masked_pg_loss(tokens: DataFrame, *by: str) -> DataFrame:
    """``-sum(A * logp * mask) / sum(mask)`` over all tokens of a group; NULL without a token."""
    weight = F.sum(F.col("advantage") * F.col("logp") * F.col("mask"))
    total = F.sum("mask")
    return tokens.groupBy(*by).agg(
        (-weight / F.nullif(total, F.lit(0.0))).alias("loss"), total.alias("n_tokens")
    )


def token_sums(tokens: DataFrame, keys: Sequence[str] = ROLLOUT) -> DataFrame:
    """Per rollout: log-prob mass of its counted tokens, of its planning tokens, and their number.

    The loss is linear in these sums, so tokens are folded on the map side and only one slim row
    per rollout is shuffled.
    """
    counted = F.col("logp") * F.col("mask")
    return tokens.groupBy(*keys).agg(
        F.sum(counted).alias("logp_sum"),
        F.sum(counted * F.col("planning").cast("double")).alias("planning_logp_sum"),
        F.sum("mask").alias("n_tokens"),
    )


def factored_pg_loss(rollouts: DataFrame, *by: str, alpha: float = HICRA_ALPHA) -> DataFrame:
    """:func:`masked_pg_loss` with planning credit, from :func:`token_sums` and ``advantage``."""
    a = F.col("advantage")
    weight = a * F.col("logp_sum") + F.lit(alpha) * F.abs(a) * F.col("planning_logp_sum")
    total = F.sum("n_tokens")
    return rollouts.groupBy(*by).agg(
        (-F.sum(weight) / F.nullif(total, F.lit(0.0))).alias("loss"), total.alias("n_tokens")
    )
