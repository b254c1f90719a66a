"""Compaction of moments, and streams that break off."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from rolloom.operators.reports import step_log
from rolloom.operators.rewards import add_group_reward
from rolloom.session import remove
from rolloom.streaming import ingest
from rolloom.streaming.step_log import (
    _folder,
    committed,
    compact,
    merge_moments,
    partial_moments,
    read_moments,
    stream_step_log,
)

LOG = "step bigint, loss double, reward double, completion_length bigint, logp double, ref_logp double"


def logged(spark, n=300, seed=1, offset=0.0):
    rng = random.Random(seed)
    rows = [
        (
            rng.choice([None, 1, 2, 3, 40]),
            rng.random(),
            None if rng.random() < 0.1 else offset + rng.random(),
            rng.randrange(9),
            rng.random(),
            rng.random(),
        )
        for _ in range(n)
    ]
    return spark.createDataFrame(rows, LOG)


def values(log):
    return {
        r.step: [None if x is None else round(x, 6) for x in r[1:]]
        for r in log.select("step", "loss", "reward", "reward_std", "completion_length", "kl").collect()
    }


def write_batches(spark, frame, out, n):
    for i in range(n):
        part = frame.filter(F.pmod(F.xxhash64("loss"), F.lit(n)) == i)
        partial_moments(part).write.parquet(_folder(out, (i, i)))


@pytest.mark.parametrize("offset", [0.0, 1e9])
def test_compacted_moments_equal_the_batch_log(spark, tmp_path, offset):
    frame, out = logged(spark, offset=offset).cache(), str(tmp_path / "out")
    write_batches(spark, frame, out, 11)
    want = values(step_log(frame))
    assert None in want
    before = values(merge_moments(read_moments(spark, out)))
    compact(spark, out, newest=10, fan_in=3)
    assert committed(spark, out) == ([(0, 8), (9, 9), (10, 10)], [])
    after = values(merge_moments(read_moments(spark, out)))
    compact(spark, out, newest=10, fan_in=3)  # nothing left to do
    assert committed(spark, out)[0] == [(0, 8), (9, 9), (10, 10)]
    for got in (before, after):
        assert set(got) == set(want)
        for step in want:
            assert got[step] == pytest.approx(want[step], rel=1e-6, abs=2e-6)


def test_a_fold_that_breaks_off_is_done_again(spark, tmp_path):
    frame, out = logged(spark, 60), str(tmp_path / "out")
    write_batches(spark, frame.cache(), out, 5)
    want = values(merge_moments(read_moments(spark, out)))

    def crash(*_):
        raise RuntimeError("lost before the parts were removed")

    with pytest.raises(RuntimeError):
        compact(spark, out, newest=4, fan_in=2, clean=crash)
    counts, replaced = committed(spark, out)
    assert counts == [(0, 3), (4, 4)] and len(replaced) > 0
    assert values(merge_moments(read_moments(spark, out))) == want  # nothing counts twice
    # a folder without its marker is as good as none
    (tmp_path / "out" / "moments-0000000000000000000-0000000000000000003" / "_SUCCESS").unlink()
    assert (0, 3) not in committed(spark, out)[0]
    assert values(merge_moments(read_moments(spark, out))) == want
    compact(spark, out, newest=4, fan_in=2)
    assert committed(spark, out) == ([(0, 3), (4, 4)], [])
    assert values(merge_moments(read_moments(spark, out))) == want


def test_the_newest_batch_and_gaps_stay_open(spark, tmp_path):
    frame, out = logged(spark, 30).cache(), str(tmp_path / "out")
    for i in (0, 3):  # batches 1 and 2 never wrote
        partial_moments(frame).write.parquet(_folder(out, (i, i)))
    compact(spark, out, newest=3, fan_in=4)
    assert committed(spark, out)[0] == [(0, 0), (3, 3)]  # batch 3 may be run again
    compact(spark, out, newest=4, fan_in=4)
    assert committed(spark, out)[0] == [(0, 3)]


def test_stream_folds_while_it_runs(spark, tmp_path):
    frame = logged(spark, 200).cache()
    source, out, mark = (str(tmp_path / x) for x in ("source", "out", "mark"))
    for i in range(9):
        part = frame.filter(F.pmod(F.xxhash64("loss"), F.lit(9)) == i)
        part.coalesce(1).write.mode("append").parquet(source)
    args = (spark, source, frame.schema, out, mark, lambda rows: rows)
    log = stream_step_log(*args, files_per_batch=1, fan_in=2)
    assert len(committed(spark, out)[0]) <= 4
    assert values(log) == values(step_log(frame))
    again = stream_step_log(*args, files_per_batch=1, fan_in=2)  # a restart with nothing new
    assert values(again) == values(log)


def test_no_batch_gives_no_rows(spark, tmp_path):
    assert merge_moments(read_moments(spark, str(tmp_path / "none"))).count() == 0


# --- one scan, two kinds ------------------------------------------------------------------------------

RESPONSES = [
    (1, "gemini", 200, '{"text":"[{\\"prompt\\":\\"p\\",\\"answer\\":\\"5\\"}, 7]"}'),
    (2, "gemini", 500, '{"text":"[{\\"prompt\\":\\"lost\\"}]"}'),
    (3, "gemini", None, "down"),
    (4, "gemini", 200, '{"text":"no list"}'),
    (5, "gemini", 200, None),
    (None, "gemini", 429, None),
]


def test_split_keeps_items_and_rejected(spark, tmp_path):
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    frame = spark.createDataFrame(RESPONSES, "batch_no bigint, provider string, status int, raw string")
    frame.coalesce(1).write.json(landing)
    ingest.stream_split(spark, landing, out, mark)
    items, rejected = ingest.read_split(spark, out)
    want_items = [(1, 0, "p", "5", True), (1, 1, None, None, False)]
    want_rejected = [(None, 429, None), (2, 500, RESPONSES[1][3]), (3, None, "down")]

    def both():
        items, rejected = ingest.read_split(spark, out)
        return sorted(map(tuple, items.collect())), sorted(map(tuple, rejected.collect()), key=repr)

    assert both() == (want_items, sorted(want_rejected, key=repr))
    # the write broke off before its commit: neither kind counts, and the batch writes both again
    marker = tmp_path / "out" / "batch=0" / "_SUCCESS"
    marker.unlink()
    assert both() == ([], [])
    remove(spark, f"{mark}/commits")
    ingest.stream_split(spark, landing, out, mark)
    assert both() == (want_items, sorted(want_rejected, key=repr))


def test_landed_files_are_scanned_once(spark):
    frame = spark.createDataFrame(RESPONSES, "batch_no bigint, provider string, status int, raw string")
    text = ingest.split_responses(frame)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Scan") == 1 and "Union" not in text
    assert text.count("ArrayType(ArrayType(StringType") == 1  # and parsed once


# --- rewards of groups ---------------------------------------------------------------------------------

ROLLOUTS = "prompt_id int, gen_idx int, prompt string, completion string, gold string"


def ranker():
    def rank(prompts, completions, gold):  # made inside a function, so that it travels by value
        assert len({*prompts}) == 1 and len(gold) == len(completions)
        order = sorted(completions)
        return [float(order.index(c)) for c in completions]

    return rank


def test_group_rewards_see_whole_groups(spark):
    rng = random.Random(5)
    rows = []
    for p in [*range(300), None]:
        letters = rng.sample("abcdefghij", 7)
        rows += [(p, i, f"q{p}", c, "g") for i, c in enumerate(letters)]
    frame = spark.createDataFrame(rows, ROLLOUTS).repartition(13)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # batches would cut groups
    try:
        found = add_group_reward(frame, "rank", ranker(), ["gold"]).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert len(found) == len(rows)
    for p in [*range(300), None]:
        mine = sorted((r.completion, r.r_rank) for r in found if r.prompt_id == p)
        assert [x for _, x in mine] == list(map(float, range(7)))


def test_group_rewards_state_their_bound(spark):
    frame = spark.createDataFrame([(1, i, "q", "c", "g") for i in range(5)], ROLLOUTS)
    with pytest.raises(ValueError, match="more than 4 rollouts"):
        add_group_reward(frame, "rank", ranker(), ["gold"], max_group=4)
    assert add_group_reward(frame.limit(0), "rank", ranker(), ["gold"]).count() == 0
    with pytest.raises(Exception, match="one value per rollout"):
        add_group_reward(frame, "few", lambda prompts, completions: [1.0]).collect()
