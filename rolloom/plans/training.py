"""The training-side plans end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1
from rolloom.operators.credit import (
    completion_mask,
    factored_pg_loss,
    group_advantage,
    normalised,
    token_sums,
)
from rolloom.operators.rewards import REWARD_SETS, add_rewards, correct_pm1, total_reward
from rolloom.operators.tokens import planning_mask, token_count, tokens
from rolloom.session import materialize

KEYS = ["prompt_id", "gen_idx"]


def score(rollouts: DataFrame, reward_set: str = "b") -> DataFrame:
    """Slim scored rollouts ``(prompt_id, gen_idx, reward)``: one narrow pass over the texts."""
    names = REWARD_SETS[reward_set]
    return total_reward(add_rewards(rollouts, names), names).select(*KEYS, "reward")


def best_rollouts(rollouts: DataFrame, reward_set: str = "b") -> DataFrame:
    """Per prompt: group statistics and the best rollout with its advantage (ties: lowest index).

    The advantage of the best rollout follows from the group's own aggregates, so scoring, group
    normalisation and the choice take one map-side combined aggregation and no join.
    """
    ranked = F.max(F.struct("reward", (-F.col("gen_idx")).alias("back")))
    groups = score(rollouts, reward_set).groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n_rollouts"),
        F.avg("reward").alias("mean_reward"),
        F.stddev_samp("reward").alias("std_reward"),
        ranked.alias("_best"),
    )
    best = F.col("_best.reward")
    return groups.select(
        "prompt_id",
        "n_rollouts",
        "mean_reward",
        "std_reward",
        (-F.col("_best.back")).alias("best_gen_idx"),
        best.alias("best_reward"),
        normalised(best, F.col("mean_reward"), F.col("std_reward")).alias("best_advantage"),
    )


def sequence_tokens(
    sequences: DataFrame, logp, compat: bool = True, carry: Sequence[str] = ()
) -> DataFrame:
    """Token rows of whole sequences with planning flag, log-prob and loss mask.

    ``logp`` is a function ``(token, index) -> Column``; ``carry`` names columns of the rollout that
    its tokens keep. Row-local throughout: ``shifted_idx`` is
    the position that predicts the token.
    """
    keyed = sequences.withColumn("prompt_len", token_count(F.col("prompt")))
    rows = planning_mask(keyed, "sequence", [*KEYS, "prompt_len", *carry], LEXICON_V1)
    shifted = F.col("token_idx") - 1
    return rows.filter(F.col("token_idx") >= 1).withColumns(
        {
            "shifted_idx": shifted,
            "logp": logp(F.col("token"), F.col("token_idx")),
            "mask": completion_mask(shifted, F.col("prompt_len"), compat),
        }
    )


def planning_credit(sequences: DataFrame, logp, compat: bool = True) -> DataFrame:
    """Loss per prompt with planning credit, from whole sequences.

    The texts are read once: reward and token sums of a rollout are folded on the map side into one
    slim row, which is written down. Group statistics, advantages and the loss work on those rows.
    A rollout without tokens adds nothing to the loss, but counts in its group.
    """
    reward = correct_pm1({x: F.col(x) for x in ("prompt", "completion", "answer")})
    keyed = sequences.withColumns({"reward": reward, "prompt_len": token_count(F.col("prompt"))})
    columns = [*KEYS, "reward", "prompt_len"]
    rows = tokens(keyed, "sequence", columns, LEXICON_V1, keep_empty=True)
    at = F.col("token_idx")
    counted = (at >= 1).cast("double") * completion_mask(at - 1, F.col("prompt_len"), compat)
    rows = rows.withColumns(
        {
            "logp": F.coalesce(logp(F.col("token"), at), F.lit(0.0)),
            "mask": F.coalesce(counted, F.lit(0.0)),
            "planning": F.coalesce("planning", F.lit(False)),
        }
    )
    slim = materialize(token_sums(rows, [*KEYS, "reward"]), "token-sums")
    return factored_pg_loss(group_advantage(slim), "prompt_id")
