"""Phrases by one automaton: the same hits as phrase by phrase, in time that phrases do not add to."""

from __future__ import annotations

import random
import time

import pytest

from rolloom.constants import LEXICON_V1
from rolloom.operators import lexicon, tokens

PHRASES = ["aa", "aba", "Wait", "let me", "xı", "ßa", "Σας", "k", "step 1", "é", "a\\Eb", "i.", "\U0001f600x"]


def texts():
    rng = random.Random(6)
    pieces = [*PHRASES, "a", "b", "A", "AB", "WAIT", "wait", "İ", "ſ", "K", "STEP 1", "É", "σΑς", "ẞ",
              " ", "\n", "é", "x", ".", "xi", "XI", "Let Me", "\U0001f600"]
    out = ["".join(rng.choices(pieces, k=rng.randrange(40))) for _ in range(400)]
    return [*out, None, "", "aaaaa", "ababababa", "I.i.İ.", "kK"]


def test_spans_equal_the_search_by_phrase(spark):
    frame = spark.createDataFrame([(i, x, "k") for i, x in enumerate(texts())], "id int, t string, end string")
    for phrases in (PHRASES, ["k", "i.", "wait", "aba", "s", "step 1"], LEXICON_V1):
        want = tokens.gram_spans(frame, "t", ["id"], phrases).collect()
        got = lexicon.lexicon_spans(frame, "t", ["id"], phrases)
        assert got.columns == ["id", "gram", "start", "end"]
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and want
    counted = {r.id: (r.n_phrases, r.n_hits) for r in
               lexicon.lexicon_counts(frame, "t", ["id"], LEXICON_V1).collect()}
    spans: dict = {}
    for r in want:
        spans.setdefault(r.id, []).append(r.gram)
    assert counted == {i: (len({*spans.get(i, [])}), len(spans.get(i, []))) for i in range(len(texts()))}
    assert lexicon.lexicon_spans(frame.limit(0), "t", ["id"], PHRASES).count() == 0


def test_a_thousand_phrases_cost_little_more_than_sixteen():
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmnop", k=5)) for _ in range(3000)]
    text = " ".join(rng.choices(words, k=400_000))
    phrases = [" ".join(rng.sample(words, 2)) for _ in range(1000)]
    table = lexicon.fold_table()
    taken = []
    for some in (phrases[:16], phrases):
        find = lexicon._finder(some, table)
        start = time.process_time()
        find(text)
        taken.append(time.process_time() - start)
    assert taken[1] < 4 * taken[0]


def test_the_lexicon_has_a_bound(spark):
    frame = spark.createDataFrame([(1, "x")], "id int, t string")
    for phrases in ([], [""], ["x"] * (lexicon.MAX_PHRASES + 1)):
        with pytest.raises(ValueError):
            lexicon.lexicon_spans(frame, "t", ["id"], phrases)
    assert lexicon.lexicon_spans(frame, "t", ["id"], ["x", "x"]).count() == 2
