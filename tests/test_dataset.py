"""Parsing, batching, chat rendering."""

from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rolloom.functions import chat
from rolloom.operators import dataset
from rolloom.operators.skew import running_sum

OBJECT = '{"prompt":"a","answer":"1"}'
# text -> expected (prompt, answer) rows; None: the text is not exactly one JSON list
PARSED = {
    f"[{OBJECT}]": [("a", "1")],
    f" [{OBJECT}]\n": [("a", "1")],
    "[]": [],
    '[{"prompt":"a","answer":2.50},{"prompt":"b","answer":1e3},{"prompt":"c","answer":7}]': [
        ("a", "2.5"),
        ("b", "1000.0"),
        ("c", "7"),
    ],
    '[{"prompt":"a","answer":123456789.125},{"prompt":"b","answer":"1.0E8"}]': [
        ("a", "123456789.125"),
        ("b", "1.0E8"),
    ],
    '[{"prompt":"a","answer":null},{"prompt":"b"}]': [("a", None), ("b", None)],
    '[{"prompt":"a","prompt":"b","answer":"1"}]': [("b", "1")],
    '[{"prompt":"caf\\u00e9 \\ud83d\\ude00","answer":"x"}]': [("café \U0001f600", "x")],
    f'[{OBJECT},"x",3]': [("a", "1"), (None, None), (None, None)],
    OBJECT: None,
    '[{"prompt":"a"': None,
    f"[{OBJECT}] trailing": None,
    f"[{OBJECT},]": None,
    "[{'prompt':'a'}]": None,
    "[][]": None,
    "[],[]": None,
    "[]],[[]": None,
    '[], "c":[]': None,
    "1],[2": None,
    '[{"prompt":"a","answer":01}]': None,
    '[{"prompt":"a\nb"}]': None,
    "": None,
    "null": None,
    "[[1]]": [(None, None)],
    "[[] ]": [(None, None)],
    "[] ]": None,
    '"s"': None,
}


def test_parse_batches(spark):
    df = spark.createDataFrame(list(enumerate(PARSED)), "batch_no bigint, text string")
    batches = dataset.parse_batches(df)
    valid = {r.text: r["items"] is not None for r in batches.collect()}
    assert valid == {text: rows is not None for text, rows in PARSED.items()}
    got: dict[str, list] = {text: [] for text in PARSED}
    texts = list(PARSED)
    for r in dataset.explode_items(batches).orderBy("batch_no", "pos").collect():
        got[texts[r.batch_no]].append((r.prompt, r.answer))
    assert got == {text: rows or [] for text, rows in PARSED.items()}


def test_json_mode_keeps_fences(spark):
    df = spark.createDataFrame([(1, "```json[]```", True), (2, "```json[]```", False)],
                               "batch_no int, text string, fenced boolean")
    rows = dataset.parse_batches(df, fenced=F.col("fenced")).orderBy("batch_no").collect()
    assert [r["items"] for r in rows] == [[], None]


@pytest.mark.parametrize("bits", [4, 21])
def test_running_sum(spark, bits):
    rng = random.Random(3)
    keys = sorted(rng.sample(range(2**18), 400)) + [2**40 + 5, 2**62]
    rows = [(k, rng.randrange(9)) for k in keys]
    df = spark.createDataFrame(rows, "k bigint, v int")
    if bits == 4:  # many levels: keep the keys small
        df, rows = df.filter(F.col("k") < 2**18), rows[:-2]
    got = running_sum(df, "k", F.col("v"), "before", bits=bits if bits > 4 else 9)
    total, expected = 0, {}
    for k, v in rows:
        expected[k] = total
        total += v
    assert {r.k: r.before for r in got.collect()} == expected


def test_collect_until_keeps_the_overshoot(spark):
    sizes = [5, 1, 90, 3, 4, 5]
    rows = [(b, p) for b, n in enumerate(sizes) for p in range(n)]
    items = spark.createDataFrame(rows, "batch_no bigint, pos bigint")
    kept = dataset.collect_until(items, 97)
    assert kept.groupBy("batch_no").count().orderBy("batch_no").collect() == [
        (0, 5), (1, 1), (2, 90), (3, 3)
    ]
    assert kept.agg(F.max("progress")).first()[0] == 99
    assert dataset.collect_until(items, 10**6).count() == sum(sizes)
    assert dataset.collect_until(items.filter("false"), 5).count() == 0


def test_draws_are_uniform_and_repeatable(spark):
    requests = spark.range(20000).withColumnRenamed("id", "req")
    one = dataset.prompt_sample(requests, "req", seed=1)
    for name, values in dataset.DIMENSIONS.items():
        counts = [r[1] for r in one.groupBy(name).count().collect()]
        assert len(counts) == len(values)
        assert max(counts) / min(counts) < 1.25
    pairs = one.groupBy("domain", "concept").count().collect()
    assert len(pairs) == 81 and min(r[2] for r in pairs) > 150
    again = dataset.prompt_sample(requests.repartition(3), "req", seed=1)
    assert one.exceptAll(again).isEmpty()
    assert not one.exceptAll(dataset.prompt_sample(requests, "req", seed=2)).isEmpty()


def test_grid_and_rendering(spark):
    grid = dataset.prompt_grid(spark)
    assert grid.count() == grid.distinct().count() == 324
    text = dataset.prompt_render(grid.limit(1)).first()
    assert f"5 unique {text.difficulty} word problems" in text.prompt
    assert f"**{text.domain}** involving **{text.concept}**" in text.prompt
    assert '{"prompt": "...", "answer": "..."}' in text.prompt and "%" not in text.prompt


def test_chat(spark):
    qa = spark.createDataFrame([("q", "5"), ("r", None)], "prompt string, answer string")
    rows = dataset.format_chat(qa).collect()
    assert [m.role for m in rows[0].prompt] == ["system", "user"]
    assert rows[0].prompt[0].content.startswith("You are") and rows[1].answer is None
    school = spark.createDataFrame([("q", "so #### 5 #### 6")], "question string, answer string")
    row = dataset.format_chat_hash(school).first()
    assert row.prompt[0].content.startswith("\nRespond") and row.prompt[0].content.endswith("\n")
    assert row.answer == "5"


def test_render_chat(spark):
    rows = [([("system", "S"), ("user", " U "), ("tool", "T"), ("assistant", "A")],), ([],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    got = df.select(
        chat.render_chat(F.col("m")),
        chat.render_chat(F.col("m"), add_generation_prompt=False, compat=True),
        chat.first_content(F.col("m")),
        chat.last_content(F.col("m")),
    ).collect()
    head = "<|start_header_id|>"
    system = f"<|begin_of_text|>{head}system<|end_header_id|>\nS<|eot_id|>"
    answer = f"{head}assistant<|end_header_id|>\n"
    assert got[0][0] == (
        f"{system}{head}user<|end_header_id|>\n U <|eot_id|>{answer}A<|eot_id|>{answer}"
    )
    assert got[0][1] == f"{system}{head}user<|end_header_id|}}\n U <|eot_id|>{answer}A<|eot_id|>"
    assert tuple(got[0][2:]) == ("S", "A")
    assert tuple(got[1]) == (answer, "", None, None)


def test_bad_rows_go_to_quarantine(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (3, None)], "x int, t string")
    marked = dataset.mark_valid(
        df, {"x missing": F.col("x").isNotNull(), "t is a": F.col("t") == "a"}
    )
    good, bad = dataset.split_valid(marked)
    assert [tuple(r) for r in good.collect()] == [(1, "a")]
    assert sorted(r.reason for r in bad.collect()) == ["t is a", "x missing"]


def test_profile(spark):
    df = spark.createDataFrame(
        [(2, "b" * 300, None), (1, "a" * 300, 5)], "id int, text string, n int"
    )
    rows = [tuple(r) for r in dataset.dataset_profile(df, "id").collect()]
    assert rows == [("text", "string", 2, 0, "a" * 100), ("n", "int", 2, 1, "5")]


def _landed(spark, tmp_path, numbers, per_batch):
    """Responses as files in batch order, and a parser that counts the texts it is given."""
    path = str(tmp_path / "landed")
    rows = [
        (n, "[" + ",".join(f'{{"prompt":"{n}-{i}","answer":"{i}"}}' for i in range(per_batch(n))) + "]")
        for n in numbers
    ]
    frame = spark.createDataFrame(rows, "batch_no bigint, text string").repartitionByRange(8, "batch_no")
    frame.write.parquet(path)
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("string")
    def counted(text: pd.Series) -> pd.Series:
        seen.add(len(text))
        return text

    frame = spark.read.parquet(path).withColumn("text", counted("text"))
    return dataset.parse_batches(frame), seen


@pytest.mark.parametrize("step,offset", [(1, 0), (1, -60_000), (1 << 40, -5)])
def test_a_prefix_of_a_long_input_is_read(spark, tmp_path, step, offset):
    """A thousand times the target follows; few more texts are parsed than kept, each of them once."""
    numbers = [offset + i * step for i in range(100_000)]
    batches, seen = _landed(spark, tmp_path, numbers, lambda n: 1)
    kept = dataset.collect_batches(batches, 100)
    assert sorted(r.batch_no for r in kept.collect()) == numbers[:100]
    assert kept.agg(F.max("progress")).first()[0] == 100
    assert 100 <= seen.value <= 300


def test_the_prefix_equals_the_whole(spark, tmp_path):
    """Empty batches, gaps and overshoot at every target, against counting everything."""
    rng = random.Random(4)
    numbers = sorted(rng.sample(range(-3000, 3000), 150)) + [10**9]
    sizes = {n: rng.choice([0, 0, 1, 2, 7]) for n in numbers}
    batches, seen = _landed(spark, tmp_path, numbers, sizes.get)
    for target in (1, 5, 60, 100_000):
        want, total = [], 0
        for n in numbers:
            if total < target and sizes[n]:
                total += sizes[n]
                want.append((n, sizes[n], total))
        before = seen.value
        got = dataset.collect_batches(batches, target).groupBy("batch_no").agg(
            F.count("*"), F.max("progress")
        )
        assert sorted(map(tuple, got.collect())) == want
        assert seen.value - before <= len(numbers)  # no text twice
    bounds = dataset.batch_range(batches)
    assert bounds == (numbers[0], 10**9, len(numbers))
    assert dataset.collect_batches(batches, 5, bounds=bounds).count() >= 5


def test_prefix_of_nothing_and_of_a_missing_number(spark):
    frame = spark.createDataFrame([(None, "[]"), (1, "[]")], "batch_no bigint, text string")
    parsed = dataset.parse_batches(frame)
    with pytest.raises(ValueError, match="NULL in batch_no"):
        dataset.collect_batches(parsed)
    assert dataset.collect_batches(parsed.filter("false")).count() == 0
    assert dataset.collect_batches(parsed.filter("batch_no = 1")).count() == 0


def test_progress_parses_texts_once(spark):
    frame = spark.createDataFrame([(1, "[1]")], "batch_no bigint, text string")
    batches = dataset.parse_batches(frame)
    size = F.greatest(F.coalesce(F.size("items"), F.lit(0)), F.lit(0))
    sizes = batches.groupBy("batch_no").agg(F.sum(size).alias("n_items")).filter("n_items > 0")
    text = sizes._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrayType(ArrayType(StringType") == 1
