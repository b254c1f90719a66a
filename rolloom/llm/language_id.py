"""Language identification by cross-parsing entropy.

For each language a suffix automaton is built over the words of a bounded number of labelled rows. A
text is parsed into the longest phrases that occur in those words, one after another; the language
that needs the fewest phrases, normalised by what its own held-back rows need, describes it best. A
phrase lies within a word and the blank before it, so a word is parsed once for all its occurrences,
and the automaton needs each different word of the sample once: whole texts are learned from.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.word_memo import WordMemo
from rolloom.llm.worker import kept
from rolloom.session import materialize

UNDETERMINED = "und"
SAMPLE_ROWS = 48  # labelled rows per language, those with the smallest hash; whole texts
_HELD_BACK = 8  # every so many sampled rows are kept out of the automaton to measure it
_SLICE = 256
_FIELD = 48  # bits of a phrase count where the counts of all languages share one integer
_LETTERS = re.compile(r"[^\W\d_]+")
_LETTER = r"\p{L}"  # in Spark's regular expressions
Words = Mapping[str, int]  # how often each word of a text occurs


def letter_words(text: str | None) -> list[str]:
    """Lower-cased words of letters; none where there is no letter."""
    words = _LETTERS.findall((text or "").lower())
    # numerals such as one half are no letters
    return words if any(any(map(str.isalpha, word)) for word in words) else []


def suffix_automaton(words: Iterable[str]) -> dict:
    """The start state; a state is a dict from characters to states.

    Every string that leads from the start occurs in one of ``words``, and the other way round.
    """
    states: list[dict] = [{}]
    link, length = [-1], [0]

    def copied(at: int, char: str, then: int) -> int:
        """A copy of ``then`` for the shorter strings that lead there from ``at`` and above."""
        copy = len(states)
        states.append(states[then].copy())
        link.append(link[then])
        length.append(length[at] + 1)
        while at >= 0 and states[at].get(char) == then:
            states[at][char] = copy
            at = link[at]
        link[then] = copy
        return copy

    for word in words:
        last = 0
        for char in word:
            then = states[last].get(char)
            if then is not None:  # known from a word before
                last = then if length[last] + 1 == length[then] else copied(last, char, then)
                continue
            now = len(states)
            states.append({})
            link.append(0)
            length.append(length[last] + 1)
            at = last
            while at >= 0 and char not in states[at]:
                states[at][char] = now
                at = link[at]
            if at >= 0:
                then = states[at][char]
                link[now] = then if length[at] + 1 == length[then] else copied(at, char, then)
            last = now
    end: dict = {}  # one for all states that lead nowhere
    kept_states = [state or end for state in states]
    for state in states:
        for char, then in state.items():
            state[char] = kept_states[then]
    return kept_states[0]


def phrases(start: dict, text: str) -> int:
    """Greedy longest phrases of ``text``; a character unknown to the automaton is one of its own."""
    count, state = 0, start
    for char in text:
        then = state.get(char)
        if then is None:
            if state is not start:
                count += 1
            then = start.get(char)
            if then is None:
                count += 1
                then = start
        state = then
    return count + (state is not start)


class LanguageModel:
    """One automaton per language, with the phrases per character that its held-back text needs."""

    def __init__(self, samples: Mapping[str, Sequence[str | Words]]):
        self._automata: dict[str, dict] = {}
        self._usual: dict[str, float] = {}
        for language, texts in sorted(samples.items()):
            counted = [x if isinstance(x, Mapping) else Counter(letter_words(x)) for x in texts]
            clean = [words for words in counted if words]
            if not clean:
                continue
            held = clean[::_HELD_BACK] if len(clean) >= _HELD_BACK else []
            learned = [x for i, x in enumerate(clean) if not held or i % _HELD_BACK]
            start = suffix_automaton(sorted({" " + w for words in learned for w in words}))
            self._automata[language] = start
            test: Counter[str] = Counter()
            for words in held or clean:
                test.update(words)
            needed = sum(n * phrases(start, " " + w) for w, n in test.items())
            self._usual[language] = needed / test.total()
        # languages are compared on one scale: a rich sample needs fewer phrases for its own text
        known = self._usual.values()
        middle = sum(known) / len(known) if known else 1.0
        self._usual = {k: x / middle for k, x in self._usual.items()}
        self._words: WordMemo[int] = WordMemo(
            lambda words: map(self._counts, words), 150_000
        )

    def _counts(self, word: str) -> int:
        """Phrases of a word in every language, each in its field of one integer."""
        out = 0
        for number, start in enumerate(self._automata.values()):
            out |= phrases(start, " " + word) << (_FIELD * number)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and score: the winner's share of the inverse normalised phrase counts."""
        return self.predict_words([letter_words(x) for x in texts])

    def predict_words(self, parsed: list[list[str]]) -> list[tuple[str, float]]:
        """The same of texts as :func:`letter_words` gives them."""
        known = self._words.covering({w for words in parsed for w in words})
        out = []
        for words in parsed:
            if not words or not self._automata:
                out.append((UNDETERMINED, 0.0))
                continue
            total = sum(map(known.__getitem__, words))
            inverse = {}
            for number, language in enumerate(self._automata):
                count = total >> (_FIELD * number) & ((1 << _FIELD) - 1)
                inverse[language] = self._usual[language] / count
            best = max(inverse, key=lambda k: (inverse[k], k))
            out.append((best, inverse[best] / sum(inverse.values())))
        return out


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for language, place, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
            words = Counter(letter_words(text))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([language]),
                    pa.array([place]),
                    pa.array([list(words)], pa.list_(pa.string())),
                    pa.array([list(words.values())], pa.list_(pa.int64())),
                ],
                ["l", "p", "words", "counts"],
            )


def language_samples(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> dict[str, list[Words]]:
    """A bounded sample of labelled rows: per language those with the smallest hash of key and text,
    each as the counts of its words.

    At most SAMPLE_ROWS rows per language are learned from, each with its whole text; of each its
    different words reach the driver. Texts without a letter are no samples, and equal rows are one: so
    a language has a sample if any of its rows has a letter, however its rows share keys.
    """
    rows = labelled.filter(F.col(label).isNotNull() & F.col(text).rlike(_LETTER))
    mark = F.xxhash64(F.col(key).cast("string"), F.col(text))
    # a cut per language below which a few times SAMPLE_ROWS different rows lie
    counts = rows.groupBy(F.col(label).alias("_l")).agg(F.approx_count_distinct(mark).alias("n"))
    share = F.least(F.lit(1.0), F.lit(4.0 * SAMPLE_ROWS) / F.col("n"))
    cuts = materialize(counts.select("_l", share.alias("_share")), "language-cuts")
    place = F.pmod(mark, F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = rows.join(cuts, F.col(label) == F.col("_l")).filter(place <= F.col("_share"))
    few = few.select(F.col(label).alias("l"), place.alias("p"), F.col(text).alias("t"))
    # chosen by their places, without the texts
    places = few.select("l", "p").distinct()
    listed = places.groupBy("l").agg(F.array_sort(F.collect_set("p")).alias("all"))
    chosen = listed.select(F.col("l").alias("_l"), F.explode(F.slice("all", 1, SAMPLE_ROWS)).alias("_p"))
    chosen = materialize(chosen, "language-rows")
    taken = few.join(chosen, (F.col("l") == F.col("_l")) & (F.col("p") == F.col("_p")))
    taken = taken.groupBy("l", "p").agg(F.min("t").alias("t"))  # equal rows are one
    words = taken.mapInArrow(
        _count_words, "l string, p double, words array<string>, counts array<bigint>"
    )
    found: dict[str, dict[float, Words]] = {}
    for row in words.collect():
        found.setdefault(row["l"], {})[row["p"]] = dict(zip(row["words"], row["counts"]))
    return {language: [of[p] for p in sorted(of)] for language, of in sorted(found.items())}


def _model(raw: bytes) -> LanguageModel:
    return kept(
        ("languages", hashlib.sha256(raw).hexdigest()), lambda: LanguageModel(pickle.loads(raw))
    )


def _predictor(raw: bytes, text: int) -> Callable:
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(at, _SLICE)
                found = model.predict(rows.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns,
                        pa.array([x for x, _ in found], pa.string()),
                        pa.array([x for _, x in found], pa.float64()),
                    ],
                    [*rows.schema.names, "_lang", "_score"],
                )

    return predict


def identify(
    df: DataFrame,
    samples: Mapping[str, Sequence[str | Words]],
    text: str = "text",
    out: str = "lang_pred",
    score: str = "score",
) -> DataFrame:
    """Adds the predicted language and its score in [0, 1], from the text alone.

    NULL texts and texts without a letter are ``und`` with score 0, and so is everything without
    samples. Ties go to the language that sorts last. Every other row stays; columns of the input that are
    named like the new ones are replaced.
    """
    raw = pickle.dumps(samples)
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    fields = [f"{n} {f.dataType.simpleString()}" for n, f in zip(names, df.schema.fields)]
    # the text is told by its place: as a column of its own it would be sent and held twice
    found = rows.mapInArrow(
        _predictor(raw, df.columns.index(text)),
        ", ".join([*fields, "_lang string", "_score double"]),
    )
    kept = [F.col(n).alias(c) for n, c in zip(names, df.columns) if c not in (out, score)]
    return found.select(*kept, F.col("_lang").alias(out), F.col("_score").alias(score))


def language_column(samples: Mapping[str, Sequence[str | Words]], text: Column) -> Column:
    """The predicted language as a column: ``und`` where nothing was learned, NULL where the text is
    NULL or has no letter. Only the text goes to the Python workers, and it does not come back.
    """
    raw = pickle.dumps(samples)

    def name(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _model(raw)
        for column in columns:
            out: list[str | None] = []
            for at in range(0, len(column), _SLICE):
                parsed = [letter_words(x) for x in column.slice(at, _SLICE).to_pylist()]
                found = model.predict_words(parsed)
                out += [x if words else None for (x, _), words in zip(found, parsed)]
            yield pa.array(out, pa.string())

    # not repeated where the column is used twice
    return F.arrow_udf(name, "string").asNondeterministic()(text)


def held_out(key: str = "doc_id") -> F.Column:
    """The third of all keys that is never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify_documents(
    df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """``(key, held_out, lang_pred, score)``: learned from the rows that are not held out.

    A NULL key is not held out.
    """
    samples = language_samples(df.filter(~held_out(key)), key, text, label)
    found = identify(df.select(key, text), samples, text)
    return found.select(key, held_out(key).alias("held_out"), "lang_pred", "score")


def tag_language(
    df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang"
) -> DataFrame:
    """The rows whose text has a letter, with ``label`` set to the language identified.

    Learned from the labelled rows that are not held out. Nothing but texts without a letter is
    rejected: without labelled rows no language is known, every other text stays, and labels stay as
    they are. The other columns are as before.
    """
    samples = language_samples(df.filter(~held_out(key)), key, text, label)
    taken = {c.lower() for c in df.columns}
    named = "_language"
    while named in taken:
        named = "_" + named
    found = df.withColumn(named, language_column(samples, F.col(f"`{text}`")))
    said = F.when(F.col(named) != UNDETERMINED, F.col(named))
    columns = [
        F.coalesce(said, F.col(f"`{c}`")).alias(c) if c == label else F.col(f"`{c}`")
        for c in df.columns
    ]
    return found.filter(F.col(named).isNotNull()).select(*columns)
