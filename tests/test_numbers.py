"""Number rendering and array scans against Python's own."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from rolloom.functions.arrays import quote, running_totals
from rolloom.functions.numbers import fixed_text, float_text

EDGES = [
    0.125, 0.375, 2.5, -0.125, 1e-9, -1e-9, 0.00005, 0.12345, 0.12355, 123456.78905, 0.0, -0.0,
    0.005, 0.015, 0.025, 1.005, 0.99999, 9.995, -0.99996, 2.0**51 + 0.5, 1e15 + 0.3, 2.0**60,
    1e-300,
]


def _values():
    rng = random.Random(5)
    ties = [rng.randrange(10**6) / 2 ** rng.randrange(1, 12) for _ in range(500)]
    short = [round(rng.uniform(-50, 50), rng.randrange(1, 7)) for _ in range(1500)]
    wide = [rng.gauss(0, 1) * 10 ** rng.randrange(-8, 9) for _ in range(1500)]
    return EDGES + ties + short + wide


@pytest.mark.parametrize("decimals", [1, 2, 4, 8])
def test_fixed_text(spark, decimals):
    df = spark.createDataFrame([(v,) for v in _values()], "v double")
    for value, text in df.select("v", fixed_text(F.col("v"), decimals)).collect():
        assert text == f"{value:.{decimals}f}", repr(value)


def test_float_text(spark):
    values = [2.5, 1000.0, 1e22, 1e-05, 0.0001, 0.00012, 123456789.123, 1e15, 1e16, 9.5e15, -3e7,
              1.5e-07, 1e100, 100.0, 4294967301.5, -1e-4]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", float_text(F.col("v"))).collect()
    assert {r[0]: r[1] for r in got} == {v: repr(v) for v in values}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 128, 129, 5000])
def test_running_totals(spark, n):
    values = [(i * 7919) % 31 for i in range(n)]
    df = spark.createDataFrame([(values,)], "a array<int>")
    expected = list(itertools.accumulate(values, initial=0))[:-1]
    assert df.select(F.expr(running_totals("a"))).first()[0] == expected


def test_quote(spark):
    text = "it's \\d \"x\" \n$"
    assert spark.sql(f"SELECT {quote(text)}").first()[0] == text
