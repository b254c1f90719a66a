"""Token offsets and planning masks against brute force on small texts."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from rolloom.constants import LEXICON_V1, LEXICON_V2
from rolloom.operators import tokens

WORDS = [
    "wait", "Wait,", "await", "let's", "look", "at", "see", "if", "the", "final", "answer", "is",
    "LET'S LOOK AT", "we can canclude", "näive", "\U0001f600", "waıt", "waİt", "x" * 30,
    "notice that", "recall", "that", "implieſ that",
]


def brute_tokens(text):
    return [(m.group(), *m.span()) for m in re.finditer("[ \t\n\x0b\f\r]*[^ \t\n\x0b\f\r]+", text)]


def brute_spans(text, phrases):
    return [
        (g, *m.span())
        for g in phrases
        for m in re.finditer(re.escape(g), text, re.IGNORECASE)
    ]


def texts():
    rng = random.Random(11)
    out = ["", " ", "wait", " \n wait \n ", "İ first i need to", "x" * 700, "wait" * 40]
    for n in (3, 20, 80, 400):
        for _ in range(6):
            out.append("".join(rng.choice(WORDS) + rng.choice([" ", "  ", "\n", "", " \t"])
                               for _ in range(n)))
    return out


@pytest.mark.parametrize(
    "phrases,chunk",
    [(LEXICON_V1, 4096), (LEXICON_V1, 32), (LEXICON_V2, 1), (["aa", "wait wait", "at a"], 32),
     (["nÄive", "\U0001f600"], 16)],
)
def test_mask_against_brute_force(spark, phrases, chunk):
    data = texts() + ["aaa aaaa a aa", "wait wait wait waitwait", "at at at a"]
    df = spark.createDataFrame(list(enumerate(data)), "id int, t string").repartition(4)
    got: dict[int, list] = {i: [] for i in range(len(data))}
    for r in tokens.tokens(df, "t", ["id"], phrases, chunk_chars=chunk).orderBy(
        "id", "token_idx"
    ).collect():
        assert r.token_idx == len(got[r.id])
        got[r.id].append((r.token, r.start, r.end, r.planning))
    found = tokens.gram_spans(df, "t", ["id"], phrases).collect()
    for i, text in enumerate(data):
        spans = brute_spans(text, phrases)
        assert sorted((r.gram, r.start, r.end) for r in found if r.id == i) == sorted(spans), text
        expected = [
            (tok, s, e, any(e > a and s < b for _, a, b in spans)) for tok, s, e in brute_tokens(text)
        ]
        assert got[i] == expected, text


def test_sweep_equals_mask(spark):
    df = spark.createDataFrame(list(enumerate(texts())), "id int, t string")
    direct = tokens.planning_mask(df, "t", ["id"]).drop("token")
    swept = tokens.mask_by_spans(
        tokens.token_offsets(df, "t", ["id"]), tokens.gram_spans(df, "t", ["id"]), ["id"]
    )
    assert direct.count() == swept.count()
    assert direct.exceptAll(swept.select(direct.columns)).isEmpty()


def test_sweep_is_dealt_out_by_its_rows(spark):
    """Texts that a join has dealt out by their key are few bytes and many tokens: not one task's."""
    joined = spark.range(3_000).join(spark.range(3_000).hint("merge"), "id")
    df = joined.selectExpr("id", "repeat('wait x ', 50) AS t")
    table, spans = tokens.token_offsets(df, "t", ["id"]), tokens.gram_spans(df, "t", ["id"])

    def per_task(**limit):
        swept = tokens.mask_by_spans(table, spans, ["id"], **limit)
        folded = swept.groupBy(F.spark_partition_id().alias("task")).agg(
            F.count(F.lit(1)).alias("n"), F.count_if("planning").alias("hits")
        )
        rows = folded.collect()
        assert (sum(r.n for r in rows), sum(r.hits for r in rows)) == (300_000, 150_000)
        return [r.n for r in rows]

    assert max(per_task()) < 100_000
    assert max(per_task(rows_per_task=20_000)) < 20_000  # spans are rows, too


def test_sequence_limit_and_counts(spark):
    df = spark.createDataFrame([(1, " a b\nc "), (2, ""), (3, "  ")], "id int, t string")
    assert tokens.planning_mask(df, "t", ["id"], seq_len=2).count() == 2
    assert [r[0] for r in df.select(tokens.token_count(F.col("t"))).collect()] == [3, 0, 0]


def test_missing_text_has_no_tokens(spark):
    df = spark.createDataFrame([(1, None), (2, "wait x")], "id int, t string")
    rows = tokens.planning_mask(df, "t", ["id"]).orderBy("token_idx").collect()
    assert [(r.id, r.token, r.planning) for r in rows] == [(2, "wait", True), (2, " x", False)]
    assert [tuple(r) for r in tokens.gram_spans(df, "t", ["id"]).collect()] == [(2, "wait", 0, 4)]


def test_budget_keeps_the_tail(spark):
    df = spark.createDataFrame([("a b c d", "x y z"), ("", "x")], "prompt string, completion string")
    rows = tokens.budget_flags(df, max_prompt=2, max_completion=2).collect()
    long, empty = rows
    assert (long.n_prompt, long.within_prompt, long.prompt_tail) == (4, False, " c d")
    assert (long.n_completion, long.within_completion, long.clipped_len) == (3, False, 2)
    assert (empty.n_prompt, empty.within_prompt, empty.prompt_tail) == (0, True, "")
    assert (empty.within_completion, empty.clipped_len) == (True, 1)


def test_long_text_stays_linear(spark):
    """A text of a million characters full of hits is one row of work, not a quadratic one."""
    text = "wait thus " * 100_000
    df = spark.createDataFrame([(1, text)], "id int, t string")
    row = tokens.planning_mask(df, "t", ["id"], LEXICON_V2).agg(
        F.count("*"), F.sum(F.col("planning").cast("int")), F.max("end")
    ).first()
    assert tuple(row) == (200_000, 200_000, len(text) - 1)
