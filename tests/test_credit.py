"""Rewards in groups, skewed groups, token credit and loss."""

from __future__ import annotations

import math
import statistics

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1, LEXICON_V2
from rolloom.operators import credit, reports
from rolloom.operators.rewards import (
    REWARD_SETS,
    REWARDS,
    add_rewards,
    python_reward,
    total_reward,
)
from rolloom.plans import derived, training


def rollout_frame(spark, rows):
    return spark.createDataFrame(rows, "prompt_id bigint, gen_idx bigint, reward double")


# --- rewards ------------------------------------------------------------------------------------


def score(spark, name, completion, answer="5", prompt="p"):
    df = spark.createDataFrame(
        [(prompt, completion, answer)], "prompt string, completion string, answer string"
    )
    return add_rewards(df, [name]).first()[f"r_{name}"]


@pytest.mark.parametrize(
    "name,completion,answer,expected",
    [
        ("correct_contains2", "<answer>15</answer>", " 5 ", 2.0),
        ("correct_contains2", "<answer>6</answer> 5", "5", 0.0),
        ("correct_contains2", "anything", "", 2.0),
        ("correct_contains2", "anything", None, 0.0),
        ("correct_exact2", "<answer> 5 </answer>", "5", 2.0),
        ("correct_exact2", "<answer>5</answer>", " 5 ", 0.0),
        ("correct_exact2", "<answer>15</answer>", "5", 0.0),
        ("correct_exact2", "<answer>5</answer>", None, 0.0),
        ("correct_contains1", "so 15 it is", "\t5\n", 1.0),
        ("correct_contains1", "none", "5", 0.0),
        ("correct_pm1", "none", "5", -1.0),
        ("correct_pm1", "x5", "5", 1.0),
        ("planning16", "Await WAIT wait, we can canclude", "", 0.2),
        ("planning16", "we can conclude thus", "", 0.0),
        ("planning16", " ".join(LEXICON_V1), "", 0.5),
        ("reasoning20", "We can conclude; step 1", "", 0.1),
        ("reasoning20", "</reasoning><reasoning> <answer></answer>", "", 0.2 + 0.1),
        ("reasoning20", "<REASONING></reasoning>", "", 0.0),
        ("reasoning20", " ".join(LEXICON_V2), "", 0.5),
    ],
)
def test_reward_values(spark, name, completion, answer, expected):
    assert score(spark, name, completion, answer) == expected


def test_phrase_sums_are_running_sums(spark):
    for n in range(1, 10):
        total = 0.0
        for _ in range(n):
            total += 0.05
        assert score(spark, "reasoning20", " ".join(LEXICON_V2[:n])) == min(total, 0.5)


def test_leaked_answer_scores_by_scope(spark):
    df = spark.createDataFrame(
        [("is it 5?", "no", "5")], "prompt string, completion string, answer string"
    )
    narrow = lambda c: REWARDS["correct_pm1"](c, scope="completion")
    row = add_rewards(df, {"seq": REWARDS["correct_pm1"], "own": narrow}).first()
    assert (row.r_seq, row.r_own) == (1.0, -1.0)


def test_four_notions_of_correct_stay_apart(spark):
    names = ["correct_contains2", "correct_exact2", "correct_contains1", "correct_pm1"]
    df = spark.createDataFrame(
        [
            ("p", "5 <answer>15</answer>", "5"),
            ("p", "5 <answer>6</answer>", "5"),
            ("p 5", "<answer>6</answer>", "5"),
            ("p", "<answer>5</answer>", "5"),
            ("p", "5 </answer> x", "5"),
        ],
        "prompt string, completion string, answer string",
    )
    rows = [tuple(r)[3:] for r in add_rewards(df, names).collect()]
    assert rows == [
        (2.0, 0.0, 1.0, 1.0),
        (0.0, 0.0, 1.0, 1.0),
        (0.0, 0.0, 0.0, 1.0),
        (2.0, 2.0, 1.0, 1.0),
        (2.0, 2.0, 1.0, 1.0),
    ]


def test_conversational_completions_and_own_rewards(spark):
    df = spark.createDataFrame(
        [("p", [("assistant", "<answer>5</answer>")], "5")],
        "prompt string, completion array<struct<role:string,content:string>>, answer string",
    )

    def length(prompts, completions, answer, **kwargs):
        return [float(len(c[0]["content"]) + len(a)) for c, a in zip(completions, answer)]

    table = {
        "exact": REWARDS["correct_exact2"],
        "length": python_reward(length, ["answer"], conversational=True),
    }
    scored = total_reward(add_rewards(df, table), list(table), weights=[1.0, 0.5])
    assert tuple(scored.select("r_exact", "r_length", "reward").first()) == (2.0, 19.0, 11.5)


def test_reward_ranges(spark):
    """Bounds and variety over whole derived rollouts."""
    rows = derived.rollouts(spark, SF_SMALL)
    scored = add_rewards(rows, list(REWARDS))
    for name, names in REWARD_SETS.items():
        scored = total_reward(scored, names, out=f"r_total_{name}")
    tops = {
        "correct_contains2": 2.0, "correct_exact2": 2.0, "correct_contains1": 1.0,
        "correct_pm1": 1.0, "planning16": 0.5, "reasoning20": 0.5, "format_search": 0.5,
        "format_strict": 0.5, "format_soft": 0.5, "int": 0.5, "xmlcount": 0.501,
        "total_a": 1.5, "total_b": 3.0, "total_c": 4.001,
    }
    low, high, kinds = (
        scored.agg(*[f(f"r_{n}").alias(n) for n in tops]).first().asDict()
        for f in (F.min, F.max, F.count_distinct)
    )
    for name, top in tops.items():
        assert high[name] <= top and kinds[name] >= 2
        assert low[name] >= (0.0 if name not in ("correct_pm1", "xmlcount", "total_c") else -10.0)


# --- groups -------------------------------------------------------------------------------------


def expected_advantages(rows):
    groups = {}
    for p, _, r in rows:
        groups.setdefault(p, []).append(r)
    out = {}
    for p, g, r in rows:
        values = groups[p]
        if len(values) == 1:
            out[p, g] = None
        else:
            out[p, g] = (r - statistics.fmean(values)) / (statistics.stdev(values) + 1e-8)
    return out


@pytest.mark.parametrize("rows_per_task", [3, 50, 1_000_000])
def test_advantage_with_a_hot_group(spark, rows_per_task):
    rows = [(7, i, float((i * 31) % 17)) for i in range(2000)]
    rows += [(p, i, float((p + i) % 5)) for p in range(100, 400) for i in range(4)]
    rows += [(1000, 0, 1.0), (1001, 0, 0.5), (1001, 1, 0.5)]
    rows += [(None, i, float(i % 3)) for i in range(300)]  # no prompt: one group of its own
    got = credit.group_advantage(rollout_frame(spark, rows), rows_per_task=rows_per_task).collect()
    expected = expected_advantages(rows)
    assert len(got) == len(rows)
    for r in got:
        want = expected[r.prompt_id, r.gen_idx]
        if want is None:
            assert r.advantage is None
        else:
            assert math.isclose(r.advantage, want, rel_tol=1e-9, abs_tol=1e-9)
    sums = {}
    for r in got:
        sums[r.prompt_id] = sums.get(r.prompt_id, 0.0) + (r.advantage or 0.0)
    assert max(map(abs, sums.values())) < 1e-6


def test_hot_group_is_spread(spark):
    """The rows of one key reach the join under many partition keys."""
    from rolloom.operators.skew import join_group_stats

    rows = rollout_frame(spark, [(7, i, 1.0) for i in range(1000)])
    stats = credit.group_stats(rows)
    joined = join_group_stats(rows, stats, ["prompt_id"], ["gen_idx"], "n_rollouts", 50)
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan
    assert joined.count() == 1000


# --- token credit -------------------------------------------------------------------------------


def test_hicra_advantage(spark):
    df = spark.createDataFrame(
        [(1.0, True), (-1.0, True), (1.0, False), (None, True)], "a double, p boolean"
    )
    got = [r[0] for r in df.select(credit.hicra_advantage(F.col("a"), F.col("p"))).collect()]
    assert got == [1.2, -0.8, 1.0, None]


def test_logprob(spark):
    df = spark.createDataFrame(
        [([1.0, 2.0, 3.0], 2), ([1000.0, 0.0], 1), ([0.5], 0), ([1.0], 7), ([1.0], None)],
        "x array<float>, y int",
    )
    got = [r[0] for r in df.select(credit.token_logprob(F.col("x"), F.col("y"))).collect()]
    log_sum = math.log(sum(math.exp(v) for v in (1, 2, 3)))
    assert got[0] == pytest.approx(3 - log_sum) and got[1] == pytest.approx(-1000)
    assert got[2:] == [0.0, None, None]


def test_shift_mask_align_and_loss(spark):
    token_rows = [(1, 0, i, f"t{i}", i == 2, float(-i - 1)) for i in range(5)]
    table = spark.createDataFrame(
        token_rows,
        "prompt_id bigint, gen_idx bigint, token_idx bigint, token string, planning boolean, "
        "logp double",
    )
    shifted = credit.shift_labels(table)
    assert [(r.shifted_idx, r.token) for r in shifted.orderBy("shifted_idx").collect()] == [
        (0, "t1"), (1, "t2"), (2, "t3"), (3, "t4")
    ]
    at = F.col("shifted_idx")
    masks = shifted.orderBy("shifted_idx").select(
        credit.completion_mask(at, F.lit(2)), credit.completion_mask(at, F.lit(2), compat=False)
    )
    assert [tuple(r) for r in masks.collect()] == [(0, 0), (0, 1), (1, 1), (1, 1)]

    advantages = shifted.select("prompt_id", "gen_idx", "shifted_idx", "planning")
    logps = shifted.filter(at < 3).select("prompt_id", "gen_idx", "shifted_idx", "logp")
    assert credit.align_min_len(advantages, logps).count() == 3

    marked = shifted.withColumns(
        {"mask": credit.completion_mask(at, F.lit(1)), "advantage": F.lit(2.0)}
    )
    final = marked.withColumn(
        "advantage", credit.hicra_advantage(F.col("advantage"), F.col("planning"))
    )
    # t2 is a planning token: 2.4 * -3; t3, t4: 2 * -4, 2 * -5; three tokens count
    expected = (2.4 * 3 + 2 * 4 + 2 * 5) / 3
    loss = credit.masked_pg_loss(final, "prompt_id").first()
    assert loss.loss == pytest.approx(expected) and loss.n_tokens == 3
    sums = credit.token_sums(marked).withColumn("advantage", F.lit(2.0))
    assert credit.factored_pg_loss(sums, "prompt_id").first().loss == pytest.approx(expected)
    empty = final.withColumn("mask", F.lit(0.0))
    assert credit.masked_pg_loss(empty, "prompt_id").first().loss is None


def test_planning_credit_counts_rollouts_without_tokens(spark):
    """Three rollouts of a prompt, one of them blank: it has no tokens, but a reward."""
    rows = [
        (1, 0, "p q", "wait so 5", "5", "p q wait so 5"),
        (1, 1, "p q", "no idea", "5", "p q no idea"),
        (1, 2, "", " ", "5", "  "),
    ]
    df = spark.createDataFrame(
        rows,
        "prompt_id bigint, gen_idx bigint, prompt string, completion string, answer string, "
        "sequence string",
    )
    loss = training.planning_credit(df, derived.token_logp, compat=False).first()
    rewards = [1.0, -1.0, -1.0]
    spread = statistics.stdev(rewards) + 1e-8
    gains = [(r - statistics.fmean(rewards)) / spread for r in rewards]

    def logp(token, at):
        return -((len(token) * 7 + at * 3) % 23 + 1) / 10

    weight = 0.0
    for gain, body in zip(gains, ([" wait", " so", " 5"], [" no", " idea"])):
        for at, token in enumerate(body, start=2):
            credit_share = gain + 0.2 * abs(gain) * (token == " wait")
            weight += credit_share * logp(token, at)
    assert loss.loss == pytest.approx(-weight / 5) and loss.n_tokens == 5


# --- reports ------------------------------------------------------------------------------------


def test_reports(spark):
    steps = spark.createDataFrame(
        [(i, i / 8, i / 4) for i in range(10)], "step bigint, loss double, mean_reward double"
    )
    lines = reports.accum_report(steps).orderBy("step").collect()
    assert [r.line for r in lines] == [
        "Step 3: Loss=0.3750, Mean Reward=0.75",
        "Step 7: Loss=0.8750, Mean Reward=1.75",
    ]
    means = reports.accum_report(steps, mode="mean").orderBy("step").collect()
    assert [(r.step, r.loss) for r in means] == [(3, 1.5 / 8), (7, 5.5 / 8)]


def test_step_log_cadence(spark):
    rows = [(s, 0.1, float(i), 10 + i) for s in range(6) for i in range(2)]
    df = spark.createDataFrame(
        rows, "step bigint, loss double, reward double, completion_length int"
    )
    log = reports.step_log(df, every=2).orderBy("step").collect()
    assert [r.step for r in log] == [0, 2, 4]
    assert log[0].reward_std == pytest.approx(math.sqrt(0.5)) and log[0].kl is None


@pytest.mark.parametrize("limit", [None, 1, 7, 5000])
def test_limit_per_task(spark, limit):
    samples = spark.range(9000).select(
        F.when(F.col("id") % 3 < 2, "big").otherwise("small").alias("task"),
        "id",
        (F.col("id") % 2).cast("double").alias("score"),
    )
    kept = reports.limit_per_task(samples, "id", limit)
    big = [r.id for r in kept.filter("task = 'big'").orderBy("id").collect()]
    everything = [i for i in range(9000) if i % 3 < 2]
    assert big == everything[:limit]
    assert reports.eval_rollup(kept).count() == 2


def test_eval_table_has_an_overall_row(spark):
    samples = spark.createDataFrame(
        [("b", 1.0), ("a", 0.0), ("a", 1.0)], "task string, score double"
    )
    rows = [tuple(r) for r in reports.eval_table(samples).collect()]
    assert rows == [
        ("a", 2, "0.5000", "± 0.5000"),
        ("b", 1, "1.0000", None),
        ("all", 3, "0.6667", "± 0.3333"),
    ]


def test_limit_with_ties_nulls_and_a_hot_task(spark):
    """Against sorting: ties by a hash of the other columns, NULL orders first, the NULL task, repeats."""
    import random

    rng = random.Random(3)
    rows = []
    for i in range(3000):
        task = rng.choice(["hot"] * 8 + ["a", None])
        order = rng.choice([None, 5, 5, -7, 2**40, -(2**62), rng.randrange(-50, 50)])
        rows.append((task, order, float(rng.randrange(40)), rng.randrange(3)))
    rows += [("same", 1, 0.5, 0)] * 400 + [("few", 3, 1.0, 1)] * 2
    samples = spark.createDataFrame(rows, "task string, at bigint, score double, k int").repartition(7)
    marked = samples.withColumn("h", F.xxhash64("score", "k")).collect()
    for limit in (1, 30, 333):
        want = []
        for task in {r.task for r in marked}:
            mine = [r for r in marked if r.task == task]
            mine.sort(key=lambda r: (r["at"] is not None, r["at"] or 0, r.h))
            want += [tuple(r)[:4] for r in mine[:limit]]
        got = [tuple(r) for r in reports.limit_per_task(samples, "at", limit).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)
    assert reports.limit_per_task(samples, "at", 0).count() == 0
    assert reports.limit_per_task(samples.limit(0), "at", 5).count() == 0
    by_score = reports.limit_per_task(samples, "at", 1, tie=["score"])
    assert by_score.groupBy("task").count().filter("count <> 1").count() == 0


def test_limit_ranks_no_samples(spark):
    samples = spark.range(500).selectExpr("'t' AS task", "id", "1.0D AS score")
    text = reports.limit_per_task(samples, "id", 9)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in text and "row_number" not in text
