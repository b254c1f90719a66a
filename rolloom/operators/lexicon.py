"""Phrases of a large lexicon in one pass: all of them are one automaton.

The work of a pass is that of the text and of its hits, whatever the number of phrases, where
:func:`rolloom.operators.tokens.gram_spans` searches once per phrase. The automaton runs in Arrow
batches of the executors' Python workers and needs the pyahocorasick library there; the few phrases of
the built-in lexicons stay in the JVM.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

MAX_PHRASES = 100_000  # they travel with each task


def _folded(char: str) -> str:
    """As the JVM compares letters without their case: one character for one, by its upper case."""
    upper = char.upper()
    upper = upper if len(upper) == 1 else char
    lower = upper.lower()
    return lower if len(lower) == 1 else "i" if char == "İ" else upper


@lru_cache(maxsize=1)
def fold_table() -> dict[int, str]:
    """For ``str.translate``: every character that is not its own folded form."""
    every = map(chr, range(sys.maxunicode + 1))
    return {ord(c): f for c in every if not 0xD800 <= ord(c) < 0xE000 and (f := _folded(c)) != c}


def _finder(phrases: Sequence[str], table: dict[int, str]) -> Callable[[str | None], list[tuple]]:
    """A function that gives (phrase number, start, end) of all hits in a text.

    Hits of one phrase do not overlap, from the left; those of different phrases may.
    """
    import ahocorasick

    same: dict[str, list[int]] = {}
    for number, phrase in enumerate(phrases):
        same.setdefault(phrase.translate(table), []).append(number)
    automaton = ahocorasick.Automaton()
    for folded, numbers in same.items():
        automaton.add_word(folded, (len(folded), numbers))
    automaton.make_automaton()

    def find(text: str | None) -> list[tuple[int, int, int]]:
        if not text:
            return []
        folded = text.lower() if text.isascii() else text.translate(table)
        free: dict[int, int] = {}  # where the next hit of a phrase may begin
        out = []
        for last, (length, numbers) in automaton.iter(folded):
            start = last + 1 - length
            if start >= free.get(numbers[0], 0):
                free[numbers[0]] = last + 1
                out += [(number, start, last + 1) for number in numbers]
        return out

    return find


def _checked(phrases: Sequence[str]) -> list[str]:
    phrases = list(phrases)
    if len(phrases) > MAX_PHRASES or not phrases or not all(phrases):
        raise ValueError(f"one to {MAX_PHRASES} phrases, none of them empty")
    return phrases


def lexicon_spans(
    df: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[str]
) -> DataFrame:
    """``(keys, gram, start, end)``: what :func:`~rolloom.operators.tokens.gram_spans` gives, for up to
    MAX_PHRASES phrases. NULL and empty texts have no hits; a phrase that is listed twice hits twice.

    Phrases of a single letter outside ASCII such as ``ß`` or ``ı`` meet all letters that fold to the
    same one here; the JVM's search takes some of them as they stand."""
    phrases, table = _checked(phrases), fold_table()
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(phrases, table)
        for batch in batches:
            hits = [(i, *hit) for i, x in enumerate(batch.column(0)) for hit in find(x.as_py())]
            rows = pa.array([h[0] for h in hits], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    *[column.take(rows) for column in batch.columns[1:]],
                    pa.array([phrases[h[1]] for h in hits], pa.string()),
                    pa.array([h[2] for h in hits], pa.int64()),
                    pa.array([h[3] for h in hits], pa.int64()),
                ],
                [*keys, "gram", "start", "end"],
            )

    schema = ", ".join([*kinds, "gram string", "start bigint", "`end` bigint"])
    return df.select(text, *keys).mapInArrow(spans, schema)


def lexicon_counts(
    df: DataFrame, text: str, keys: Sequence[str], phrases: Sequence[str]
) -> DataFrame:
    """``(keys, n_phrases, n_hits)`` per row: how many different phrases occur, and how many hits."""
    phrases, table = _checked(phrases), fold_table()
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _finder(phrases, table)
        for batch in batches:
            found = [[hit[0] for hit in find(x.as_py())] for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[1:],
                    pa.array([len(set(x)) for x in found], pa.int64()),
                    pa.array([len(x) for x in found], pa.int64()),
                ],
                [*keys, "n_phrases", "n_hits"],
            )

    schema = ", ".join([*kinds, "n_phrases bigint", "n_hits bigint"])
    return df.select(text, *keys).mapInArrow(counts, schema)
