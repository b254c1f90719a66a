"""Scores and advantages of logged rollouts.

spark-submit examples/score_rollouts.py ROLLOUTS OUT [REWARD_SET]

ROLLOUTS: Parquet with prompt_id, gen_idx, prompt, completion, answer. REWARD_SET is a, b or c.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from rolloom.operators.credit import group_advantage  # noqa: E402
from rolloom.operators.rewards import REWARD_SETS, add_rewards, total_reward  # noqa: E402
from rolloom.session import materialize  # noqa: E402


def main(rollouts: str, out: str, reward_set: str = "b") -> None:
    spark = SparkSession.builder.appName("score-rollouts").getOrCreate()
    names = REWARD_SETS[reward_set]
    scored = total_reward(add_rewards(spark.read.parquet(rollouts), names), names)
    columns = ["prompt_id", "gen_idx", *[f"r_{n}" for n in names], "reward"]
    slim = materialize(scored.select(*columns), "scored")
    group_advantage(slim).write.mode("overwrite").parquet(out)


if __name__ == "__main__":
    main(*sys.argv[1:4])
