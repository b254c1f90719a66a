"""String rules on hostile texts: expected values are written out."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rolloom.constants import WHITESPACE
from rolloom.functions import text as T
from rolloom.operators.rewards import add_rewards

# text, guarded answer, plain answer, hash answer, tag score, layout found, strict, soft, digits
HOSTILE = [
    ('<reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\n', '42', '42', None, 0.5, True, True, False, True),
    ('<reasoning>\r\nr\r\n</reasoning>\r\n<answer>\r\n42\r\n</answer>\r\n', '42', '42', None, 0.124, True, False, False, True),
    ('<reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\n\n', '42', '42', None, 0.498, True, True, False, True),
    ('<reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\n\n\n', '42', '42', None, 0.496, True, False, False, True),
    ('hi <reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\n', '42', '42', None, 0.5, True, False, False, True),
    ('<reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\nbye', '42', '42', None, 0.494, True, False, False, True),
    ('half </answer> tail', 'half </answer> tail', 'half', None, 0.0, False, False, False, False),
    ('<answer>1</answer> <answer> 2 </answer> z', '2', '2', None, 0.0, False, False, False, True),
    ('', '', '', None, 0.0, False, False, False, False),
    ('<reasoning>\na\x85b\n</reasoning>\n<answer>\n7\n</answer>\n', '7', '7', None, 0.5, True, True, False, True),
    ('<reasoning>\na\u2028b\n</reasoning>\n<answer>\n7\n</answer>\n', '7', '7', None, 0.5, True, True, False, True),
    ('<reasoning>\nr\n</reasoning>\n<answer>\n42\n</answer>\n\u2028', '42', '42', None, 0.498, True, False, False, True),
    ('<reasoning>x</reasoning>\xa0<answer>5\xa0</answer>', '5', '5', None, 0.0, True, False, True, True),
    ('<answer>\x1c9\x1f</answer>', '9', '9', None, 0.0, False, False, False, True),
    ('<answer>\xb2</answer>', '\xb2', '\xb2', None, 0.0, False, False, False, True),
    ('<answer>\u0663\u0664</answer>', '\u0663\u0664', '\u0663\u0664', None, 0.0, False, False, False, True),
    ('<answer>-5</answer>', '-5', '-5', None, 0.0, False, False, False, False),
    ('<answer>4.0</answer>', '4.0', '4.0', None, 0.0, False, False, False, False),
    ('x\n</answer>\n</answer>\n', 'x\n</answer>\n</answer>', 'x', None, 0.0, False, False, False, False),
    ('<reasoning>\n<reasoning>\nq\n</reasoning>\n', '<reasoning>\n<reasoning>\nq\n</reasoning>', '<reasoning>\n<reasoning>\nq\n</reasoning>', None, 0.125, False, False, False, False),
    ('\n<answer>\nq', 'q', 'q', None, 0.114, False, False, False, False),
    ('a####b####c', 'a####b####c', 'a####b####c', 'b', 0.0, False, False, False, False),
    ('#####x', '#####x', '#####x', '#x', 0.0, False, False, False, False),
    ('####', '####', '####', '', 0.0, False, False, False, False),
    (' \t plain \u3000', 'plain', 'plain', None, 0.0, False, False, False, False),
    ('<answer>\U0001f600 9</answer>', '\U0001f600 9', '\U0001f600 9', None, 0.0, False, False, False, False),
    ('<reasoning>a\nb</reasoning><answer>1</answer>', '1', '1', None, 0.0, True, False, False, True),
    ('<reasoning>a</reasoning><answer>1\n2</answer>', '1\n2', '1\n2', None, 0.0, True, False, False, False),
    ('\n<answer>\n1\n</answer>\n\n</answer>', '1', '1', None, 0.115, False, False, False, True),
    ('\n</answer>', '</answer>', '', None, 0.126, False, False, False, False),
    ('<ANSWER>3</ANSWER>', '<ANSWER>3</ANSWER>', '<ANSWER>3</ANSWER>', None, 0.0, False, False, False, False),
    ('<answer>8', '8', '8', None, 0.0, False, False, False, True),
    ('\u2460', '\u2460', '\u2460', None, 0.0, False, False, False, True),
]


def test_hostile_texts(spark):
    df = spark.createDataFrame(
        [(i, row[0]) for i, row in enumerate(HOSTILE)], "i int, completion string"
    ).withColumns({"prompt": F.lit("p"), "answer": F.lit("1")})
    df = add_rewards(df, ["format_search", "format_strict", "format_soft", "int", "xmlcount"])
    c = F.col("completion")
    got = df.select(
        "i",
        T.xml_answer(c),
        T.xml_answer(c, guarded=False),
        T.hash_answer(c),
        F.round("r_xmlcount", 6),
        *[F.col(f"r_{x}") == 0.5 for x in ("format_search", "format_strict", "format_soft", "int")],
    ).collect()
    for row in got:
        assert tuple(row)[1:] == HOSTILE[row[0]][1:], HOSTILE[row[0]][0]


def test_whitespace_set_is_the_full_one():
    assert set(WHITESPACE) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_digit_class_follows_isdigit(spark):
    sample = "0\u00b2\u2079\u2460\u0669\uff15\u00bdIx-\u216b\u3007"
    df = spark.createDataFrame([(c,) for c in sample], "c string")
    got = df.select("c", F.rlike("c", F.lit(f"\\A{T.digit_class()}\\z"))).collect()
    assert {r[0]: r[1] for r in got} == {c: c.isdigit() for c in sample}


def test_strip_fences(spark):
    cases = {
        "```json\n[1]\n```": "[1]",
        "a ```JSON b``` ": "a JSON b",
        " x```y```json z\u00a0": "xy z",
        "````": "`",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = df.select("t", T.strip_fences(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == cases


@pytest.mark.parametrize("literal", ["a.b", "\\E", "x\\Ey", "[^"])
def test_regex_quote(spark, literal):
    df = spark.createDataFrame([(f"1{literal}2{literal}3",)], "t string")
    assert df.select(F.split("t", T.regex_quote(literal), -1)).first()[0] == ["1", "2", "3"]


def test_quoted_list(spark):
    items = ["5", "it's", 'say "x"', "it's \"x\"", "a\\b\nc\td\re", ""]
    df = spark.createDataFrame([(items,), ([],)], "a array<string>")
    got = [r[0] for r in df.select(T.quoted_list(F.col("a"))).collect()]
    assert got == [repr(items), "[]"]
