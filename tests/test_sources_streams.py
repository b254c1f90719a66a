"""Files in, files out, and the streaming forms against their batch forms."""

from __future__ import annotations

import glob
import json

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from rolloom.operators import reports
from rolloom.plans import derived
from rolloom.session import materialize, scratch_path
from rolloom.sources import qa
from rolloom.sources import reports as report_source
from rolloom.sources.responses import TEXT_PATHS, split_by_status, unwrap_response
from rolloom.streaming.ingest import parse_responses, stream_ingest
from rolloom.streaming.step_log import merge_moments, partial_moments, stream_step_log

ROWS = [
    ('A "quoted" $5\\frac{1}{2}$', "1/2"),
    ("line\nbreak é \U0001f600", "(4, 15.5)"),
    ("none", None),
]


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_json_array_files(spark, tmp_path, parts):
    rows = ROWS * 40
    df = spark.createDataFrame(rows, qa.QA_SCHEMA).repartition(parts)
    path = str(tmp_path / "out")
    qa.write_qa_json_array(df, path)
    loaded = []
    for name in glob.glob(f"{path}/part-*"):
        with open(name, encoding="utf8") as file:
            loaded += [(d["prompt"], d["answer"]) for d in json.load(file)]
    assert sorted(loaded, key=repr) == sorted(rows, key=repr)
    back = qa.read_qa_json(spark, path, "train")
    assert sorted((tuple(r)[:2] for r in back.collect()), key=repr) == sorted(rows, key=repr)
    assert back.select("split").distinct().collect() == [("train",)]


def test_empty_json_array(spark, tmp_path):
    qa.write_qa_json_array(spark.createDataFrame([], qa.QA_SCHEMA), str(tmp_path / "out"))
    assert qa.read_qa_json(spark, str(tmp_path / "out"), "test").count() == 0


def test_indented_array_with_typed_answers(spark, tmp_path):
    data = [{"prompt": "a", "answer": 2.5}, {"prompt": "b", "answer": "x"}, {"prompt": "c", "answer": 7}]
    file = tmp_path / "qa.json"
    file.write_text(json.dumps(data, indent=2), encoding="utf8")
    rows = qa.read_qa_json(spark, str(file), "test").orderBy("prompt").collect()
    assert [tuple(r) for r in rows] == [("a", "2.5", "test"), ("b", "x", "test"), ("c", "7", "test")]


def test_json_lines_overwrite(spark, tmp_path):
    path = str(tmp_path / "lines")
    for rows in (ROWS, ROWS[:2]):
        qa.write_qa_json(spark.createDataFrame(rows, qa.QA_SCHEMA), path)
    back = [tuple(r) for r in qa.read_qa_json_lines(spark, path).collect()]
    assert sorted(back) == sorted(ROWS[:2])


def test_split_tree_reads_one_partition(spark, tmp_path):
    df = spark.range(30).select(
        "id",
        F.lit("main").alias("config"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
    )
    path = str(tmp_path / "tree")
    qa.write_split_tree(df, path)
    test = qa.read_split(spark, path, "main", "test")
    assert test.count() == 10
    plan = test._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "(split" in plan.split("PartitionFilters:")[1][:200]


def test_unwrap_and_status(spark):
    rows = [
        (1, "ANTHROPIC", 200, '{"content":[{"type":"text","text":"a"}]}'),
        (2, "huggingface", 201, '{"choices":[{"message":{"content":"b"}}]}'),
        (3, None, 200, '{"text":"c"}'),
        (4, "other", 503, '{"text":"d"}'),
        (5, "gemini", None, '{"error":1}'),
        (6, "gemini", 200, "no json"),
    ]
    df = spark.createDataFrame(rows, "batch_no bigint, provider string, status int, raw string")
    texts = [(r.provider, r.text) for r in unwrap_response(df).orderBy("batch_no").collect()]
    assert texts == [("anthropic", "a"), ("huggingface", "b"), ("gemini", "c"), ("gemini", "d"),
                     ("gemini", None), ("gemini", None)]
    two = {k: v for k, v in TEXT_PATHS.items() if k != "huggingface"}
    first = unwrap_response(df, paths=two).filter("batch_no = 2").first()
    assert (first.provider, first.text) == ("gemini", None)
    good, bad = split_by_status(df)
    assert good.count() == 4 and sorted(r.batch_no for r in bad.collect()) == [4, 5]


def test_eval_json(spark, tmp_path):
    samples = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "task string, score double")
    rolled = reports.eval_rollup(samples)
    path = str(tmp_path / "eval")
    report_source.write_eval_json(rolled, path)
    back = report_source.read_eval_json(spark, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rolled.collect()))


def test_scratch_follows_the_session(spark, tmp_path):
    first, second = scratch_path(spark, "x"), scratch_path(spark, "x")
    assert first != second
    kept = materialize(spark.range(5), "five")
    assert kept.schema["id"].dataType.simpleString() == "bigint" and kept.count() == 5


def test_stream_ingest_equals_batch_and_continues(spark, tmp_path):
    responses = derived.responses(spark, SF_SMALL)
    landing, out, mark = (str(tmp_path / x) for x in ("landing", "out", "mark"))
    early = F.col("batch_no") % 2 == 0
    responses.filter(early).write.mode("append").json(landing)
    stream_ingest(spark, landing, out, mark)
    half = spark.read.parquet(out).count()
    stream_ingest(spark, landing, out, mark)  # nothing new: nothing added
    assert spark.read.parquet(out).count() == half
    responses.filter(~early).write.mode("append").json(landing)
    stream_ingest(spark, landing, out, mark)
    streamed, batch = spark.read.parquet(out), parse_responses(responses)
    assert streamed.count() == batch.count() > half
    assert batch.exceptAll(streamed.select(batch.columns)).isEmpty()


def test_stream_step_log_equals_batch(spark, tmp_path):
    events = derived.table(spark, SF_SMALL, "events")
    source, out, mark = (str(tmp_path / x) for x in ("source", "out", "mark"))
    columns = ["step", "loss", "reward", "reward_std", "completion_length"]
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        events.filter(part).coalesce(1).write.mode("append").parquet(source)
        log = stream_step_log(
            spark, source, events.schema, out, mark, derived.events_as_rollouts
        )
    want = reports.step_log(derived.events_as_rollouts(events))
    rounded = [F.round(c, 6).alias(c) for c in columns]
    assert log.count() == want.count()
    assert want.select(*rounded).exceptAll(log.select(*rounded)).isEmpty()


def test_partial_moments_merge(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 5.0, 3), (1, 2.0, 7.0, 4), (1, 3.0, 12.0, 5), (2, 1.0, 1.0, 1)],
        "step int, loss double, reward double, completion_length int",
    )
    parts = [partial_moments(df.filter(F.col("loss") == x)) for x in (1.0, 2.0, 3.0)]
    merged = merge_moments(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    rows = {r.step: r for r in merged.collect()}
    assert rows[1].reward == 8.0 and rows[1].reward_std == pytest.approx(13**0.5)
    assert rows[2].reward_std is None


def test_temporary_tables_go_and_others_stay(spark):
    from pathlib import Path
    from urllib.parse import unquote, urlparse

    from rolloom.session import temporary_tables

    def folder(df):
        return Path(unquote(urlparse(df.inputFiles()[0]).path)).parent

    outer = folder(materialize(spark.range(3), "outer"))
    with temporary_tables(spark):
        inner = folder(materialize(spark.range(3), "inner"))
        assert inner.exists()
    assert outer.exists() and not inner.exists()
