"""What the plans may and may not contain."""

from __future__ import annotations

import re

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from rolloom.operators import credit, dataset, tokens
from rolloom.plans import derived, training
from rolloom.plans.queries import QUERIES

PYTHON_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "PythonUDF")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def shuffles(text: str) -> int:
    return len(re.findall(r"Exchange hashpartitioning", text))


@pytest.fixture
def no_auto_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_python_no_single_task(spark, name):
    text = plan(QUERIES[name](spark, SF_SMALL))
    # a user's own Python function, and the automaton of large lexicons
    if name not in ("reward_registry", "reward_group", "gram_spans_lexicon", "lexicon_counts"):
        assert not any(node in text for node in PYTHON_NODES)
    assert "CartesianProduct" not in text and "NestedLoopJoin" not in text
    # one task only for a global aggregate of partial results
    if "SinglePartition" in text:
        assert name == "dataset_profile" and "partial_" in text
    assert "collect_list" not in text and "collect_set" not in text


def test_rewards_are_one_narrow_pass(spark):
    rows = derived.rollouts(spark, SF_SMALL).select("prompt_id", "gen_idx", "prompt", "answer",
                                                    "completion")
    before, after = plan(rows), plan(training.score(rows, "c"))
    assert shuffles(before) == shuffles(after)


def test_tokens_never_cross_a_shuffle(spark):
    rows = derived.rollouts(spark, SF_SMALL)
    keys = ["prompt_id", "gen_idx"]
    masked = tokens.planning_mask(rows, "completion", keys)
    assert shuffles(plan(rows)) == shuffles(plan(masked))
    # folding tokens to rollouts shuffles partial sums only
    folded = masked.withColumns({"logp": F.lit(-1.0), "mask": F.lit(1.0)})
    text = plan(credit.token_sums(folded, keys))
    assert text.index("partial_sum") > text.index("Exchange hashpartitioning")


def test_texts_are_parsed_once(spark):
    text = plan(QUERIES["parse_qa_batch"](spark, SF_SMALL))
    assert text.count("ArrayType(ArrayType(StringType") == 1
    filters = [line for line in text.splitlines() if "Filter" in line]
    assert filters and not any("JsonToStructs" in line for line in filters)


def test_group_statistics_combine_before_the_shuffle(spark, no_auto_broadcast):
    scored = spark.range(100).selectExpr("id % 9 AS prompt_id", "id AS gen_idx", "id / 7 AS reward")
    text = plan(credit.group_advantage(scored))
    assert "partial_stddev_samp" in text
    assert re.search(r"Exchange hashpartitioning\([^\n]*prompt_id[^\n]*_part#\d+", text)
    assert "Window" not in text


def test_best_rollouts_take_one_aggregation(spark, no_auto_broadcast):
    rows = spark.createDataFrame(
        [(1, 0, "p", "5", "<answer>5</answer>")],
        "prompt_id bigint, gen_idx bigint, prompt string, answer string, completion string",
    )
    text = plan(training.best_rollouts(rows))
    assert shuffles(text) == 1 and "Join" not in text


def test_pushdown_and_pruning(spark):
    text = plan(QUERIES["accum_report"](spark, SF_SMALL))
    assert "ReadSchema: struct<event_id:bigint,value:double,props:string>" in text
    text = plan(derived.responses(spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,assistant)" in text
    text = plan(QUERIES["prompt_sample"](spark, SF_SMALL))
    assert "ReadSchema: struct<doc_id:bigint>" in text


def test_hot_prompt_is_split_at_run_time(spark, no_auto_broadcast, tmp_path):
    """One prompt with most completions: adaptive execution splits its partition."""
    path = str(tmp_path / "rows")
    spark.range(400_000).select(
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(7).alias("prompt_id"),
        F.sha2(F.col("id").cast("string"), 512).alias("completion"),
    ).repartition(16).write.parquet(path)
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "256KB",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256KB",
    }
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        prompts = spark.range(400_000).selectExpr("id AS prompt_id", "'5' AS answer")
        joined = dataset.zip_answers(spark.read.parquet(path), prompts)
        hot = F.col("prompt_id") == 7
        result = joined.agg(
            F.count("*"), F.count_if(hot), F.sum(F.length(F.concat("completion", "answer")))
        )
        row = result.collect()[0]
        assert row[0] == 400_000 and row[1] == 266_666
        assert "skew=true" in plan(result)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
