"""Token counts by a deterministic transducer compiled from a SentencePiece BPE model.

The last token of a text is decided by the text before it: token t ends a prefix exactly if the
prefix without t ends in a token that t may follow, i.e. the pair is tokenised as that pair. So a
state needs the characters that a longer token may still take in, and for each place among them the
last token there; reading a character moves to one next state and changes the number of tokens by a
fixed amount, which is written on the transition. States are made when first reached.

Where two neighbouring characters stand side by side in no piece, no token and no join crosses, so the
transducer is back in its start state between them, whatever came before. Blanks behind other
characters are such places, and so are most pairs of ideographs, of cases and of digits and letters. A
chunk of a text is a map from the state before it to the state behind it and the tokens between: the
characters up to its first such place, a count, and the state at its end. Maps compose associatively;
those of a text's chunks are combined pairwise, round by round. Only a text that repeats pairs of the
pieces without end, such as one letter over and over, has no such place and keeps its characters.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolloom.llm.sentencepiece_codec import BLANK, read_model
from rolloom.llm.word_memo import WordMemo
from rolloom.llm.worker import kept

CHUNK_CHARS = 1 << 16
MAX_STATES = 240_000
_NORMAL, _USER, _UNUSED, _BYTE = 1, 4, 5, 6  # piece types of the protobuf
_SLICE = 256

State = dict  # character -> (next state, tokens); its key under None


class CountingTransducer:
    def __init__(self, path: str):
        proto = read_model(path)
        spec = proto.normalizer_spec
        usable = {p.piece: p.score for p in proto.pieces if p.type in (_NORMAL, _UNUSED)}
        supported = (
            proto.trainer_spec.model_type == proto.trainer_spec.BPE
            and not spec.precompiled_charsmap
            and not spec.remove_extra_whitespaces
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not any(p.type in (_USER, _UNUSED) for p in proto.pieces)
            and not any(BLANK in piece.lstrip(BLANK) for piece in usable)
        )
        if not supported:
            raise ValueError("only BPE models without a character map or user pieces are compiled")
        self._score = usable
        self._bytes = sum(p.type == _BYTE for p in proto.pieces) == 256
        self._prefixes = {piece[:n] for piece in usable for n in range(1, len(piece) + 1)}
        self._pairs = {piece[n : n + 2] for piece in usable for n in range(len(piece) - 1)}
        self._known: dict[tuple, State] = {}
        self._shared: dict[tuple, tuple] = {}  # places, one object for all states that have them
        self._alone = lru_cache(1 << 16)(lambda t: self.tokens(t) == [t])
        self._follows = lru_cache(1 << 16)(self._follow)
        self._made = lru_cache(1 << 15)(self._steps)
        self.start = self._state("", ((0, ""),))
        self.words: WordMemo[int] = WordMemo(
            lambda words: [self._word(w) for w in words], 150_000
        )

    def _best(self, parts: list[str]) -> tuple[float, int] | None:
        """Score and (negative) place of the pair to be joined next: the best one, the leftmost of
        equals."""
        joins = enumerate(map(str.__add__, parts, parts[1:]))
        return max(((self._score[j], -i) for i, j in joins if j in self._score), default=None)

    def tokens(self, text: str) -> list[str]:
        """The merge rule itself, for the short texts that states are made from."""
        parts = list(text)
        while (best := self._best(parts)) is not None:
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _steps(self, token: str) -> list[tuple[float | None, str, str]]:
        """How a token comes about: before each join its score and the outer parts, left and right."""
        parts, steps = list(token), []
        while (best := self._best(parts)) is not None:
            steps.append((best[0], parts[0], parts[-1]))
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        steps.append((None, parts[0], parts[-1]))
        return steps

    def _follow(self, left: str, right: str) -> bool:
        """Whether two tokens side by side stay as they are. The joins inside them are gone through
        in the order of the merge rule; a join across their border must never be the next one."""
        lefts, rights = self._made(left), self._made(right)
        i = j = 0
        while True:
            in_left, _, edge = lefts[i]
            in_right, other, _ = rights[j]
            across = self._score.get(edge + other)
            if (
                across is not None
                and (in_left is None or across > in_left)
                and (in_right is None or across >= in_right)
            ):
                return False
            if in_left is not None and (in_right is None or in_left >= in_right):
                i += 1
            elif in_right is not None:
                j += 1
            else:
                return True

    def _state(self, taken: str, places: tuple[tuple[int, str] | None, ...]) -> State:
        """``taken``: the characters that a token to come may begin with. ``places``: for each place
        before, between and behind them the tokens up to there, less those up to the end, and the
        last token there ('' where nothing can reach across); None where no token can begin."""
        key = taken, places
        state = self._known.get(key)
        if state is None:
            if len(self._known) >= MAX_STATES:
                self._forget()
            share = self._shared.setdefault
            key = taken, tuple([None if p is None else share(p, p) for p in places])
            state = self._known[key] = {None: key}
        return state

    def _forget(self) -> None:
        """Drops all states but the start; those in use stay valid, others are made again. The start
        leads to every state, so its transitions go, too."""
        begin = self.start[None]
        self.start.clear()
        self.start[None] = begin
        self._known.clear()
        self._shared.clear()
        self._known[begin] = self.start

    def _next(self, state: State, char: str) -> tuple[State, int]:
        taken, places = state[None]
        score, prefixes = self._score, self._prefixes
        if char not in score:  # an unknown character joins with nothing
            return self.start, len(char.encode()) if self._bytes else 1
        read = taken + char
        for i, place in enumerate(places):  # the longest first
            token = read[i:]
            if place is None or token not in score or not self._alone(token):
                continue
            if not place[1] or self._follows(place[1], token):
                break
        added = place[0] + 1
        begin = 0
        while read[begin:] not in prefixes:
            begin += 1
            if begin == len(read):
                break
        now = [
            (places[i][0] - added, places[i][1])
            if places[i] is not None and read[i:] in prefixes
            else None
            for i in range(begin, len(places))
        ]
        return self._state(read[begin:], (*now, (0, token))), added

    def run(self, state: State, text: str) -> tuple[State, int]:
        total = 0
        for char in text:
            step = state.get(char)
            if step is None:
                step = state[char] = self._next(state, char)
            state, added = step
            total += added
        return state, total

    def restore(self, key: str) -> State:
        taken, places = json.loads(key)
        return self._state(taken, tuple(None if p is None else tuple(p) for p in places))

    @staticmethod
    def _saved(state: State) -> str:
        return json.dumps(state[None], ensure_ascii=False)

    def _word(self, word: str) -> int:
        return self.run(self.start, BLANK + word)[1]

    def count(self, text: str) -> int:
        """Tokens of a whole text."""
        return self.counts([text])[0]

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of whole texts. Where single blanks part the words, each word is one way from the
        start state back to it, taken at once."""
        parted = [
            x.split(" ")
            if x and BLANK not in x and "  " not in x and x[0] != " " and x[-1] != " "
            else None
            for x in texts
        ]
        known = self.words.covering({w for words in parted for w in words or ()})
        sums = [None if words is None else sum(map(known.__getitem__, words)) for words in parted]
        return [
            sums[i]
            if sums[i] is not None
            else self.apply(self.start, self.chunk_map(x, None))[1] if x else 0
            for i, x in enumerate(texts)
        ]

    def chunk_map(self, chunk: str, before: str | None) -> dict:
        """The map of a chunk behind the character ``before``; None: the chunk begins its text.

        ``head``: what is read in the state before the chunk; ``state``: the state at the end, None
        if the head is all; ``tokens``: of what follows the head.
        """
        chunk = chunk.replace(" ", BLANK)
        at = 0
        if before is None:
            chunk = BLANK + chunk
        else:
            last = BLANK if before == " " else before
            while at < len(chunk) and last + chunk[at] in self._pairs:
                last = chunk[at]
                at += 1
        head, rest = chunk[:at], chunk[at:]
        if not rest:
            return {"head": head, "tokens": 0, "state": None}
        first, *runs = re.findall(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+", rest)
        last_run = runs.pop() if runs else None
        plain = [r[1:] for r in runs]
        known = self.words.covering(set(plain))
        state, tokens = self.run(self.start, first)
        if last_run is not None:
            state, tail = self.run(self.start, last_run)
            tokens += sum(map(known.__getitem__, plain)) + tail
        return {"head": head, "tokens": tokens, "state": self._saved(state)}

    def apply(self, state: State, chunk: dict) -> tuple[State, int]:
        state, tokens = self.run(state, chunk["head"])
        if chunk["state"] is not None:
            state = self.restore(chunk["state"])
        return state, tokens + chunk["tokens"]

    def compose(self, left: dict, right: dict) -> dict:
        """The map of two neighbouring chunks."""
        if left["state"] is None:
            return right | {"head": left["head"] + right["head"]}
        state, tokens = self.apply(self.restore(left["state"]), right)
        return {"head": left["head"], "tokens": left["tokens"] + tokens, "state": self._saved(state)}

    def compose_all(self, maps: list[dict]) -> dict:
        while len(maps) > 1:
            pairs = [self.compose(a, b) for a, b in zip(maps[::2], maps[1::2])]
            maps = pairs + maps[len(pairs) * 2 :]
        return maps[0]


def _chunk_maps(model: str) -> Callable:
    def maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = kept(("transducer", model), lambda: CountingTransducer(model))
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                rows = batch.slice(at, _SLICE)
                nos, texts, befores, wholes = (
                    rows.column(c).to_pylist() for c in ("no", "chunk", "before", "whole")
                )
                counts = iter(transducer.counts([x or "" for x, one in zip(texts, wholes) if one]))
                found = [
                    # nothing follows a whole text: the state at its end is of no use
                    {"head": "", "tokens": next(counts), "state": None}
                    if whole
                    else transducer.chunk_map(chunk, before if no else None)
                    for no, chunk, before, whole in zip(nos, texts, befores, wholes)
                ]
                made = pa.RecordBatch.from_pylist(
                    found,
                    schema=pa.schema(
                        [("head", pa.string()), ("tokens", pa.int64()), ("state", pa.string())]
                    ),
                )
                carried = [rows.column(c) for c in ("row", "key", "n_bytes", "no")]
                yield pa.RecordBatch.from_arrays(
                    [*carried, *made.columns],
                    ["row", "key", "n_bytes", "no", "head", "tokens", "state"],
                )

    return maps


def _composed(model: str) -> Callable:
    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = None
        for batch in batches:
            counts = []
            for maps in batch.column("maps"):
                if len(maps) == 1:
                    counts.append(maps[0]["tokens"].as_py())
                    continue
                if transducer is None:
                    transducer = kept(("transducer", model), lambda: CountingTransducer(model))
                whole = transducer.compose_all(maps.as_py())
                counts.append(whole["tokens"])
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("n_bytes"), pa.array(counts, pa.int64())],
                ["key", "n_bytes", "n_tokens"],
            )

    return compose


def count_tokens(
    df: DataFrame,
    model: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = 4096,
    chunk_chars: int = CHUNK_CHARS,
) -> DataFrame:
    """``(key, n_bytes, n_tokens, over_limit)`` per row: what sentencepiece counts for whole texts.

    Texts are cut every ``chunk_chars`` characters, the chunks are mapped apart, and only the maps of
    a text, without its characters but for a word that is cut, come together. NULL and empty texts
    have no tokens. Every row is there once: rows are told apart by a running number, not by key.
    Other columns are not looked at.
    """
    kind = df.schema[key].dataType.simpleString()
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.octet_length(body).cast("bigint").alias("n_bytes"),
        F.regexp_extract_all(body, F.lit(f"(?s).{{1,{chunk_chars}}}"), F.lit(0)).alias("chunks"),
    )
    chunks = rows.select(
        "row",
        "key",
        "n_bytes",
        "chunks",
        F.posexplode_outer("chunks").alias("no", "chunk"),
    ).select(
        "row",
        "key",
        "n_bytes",
        "no",
        "chunk",
        F.right(F.get("chunks", F.col("no") - 1), F.lit(1)).alias("before"),
        (F.size("chunks") < 2).alias("whole"),
    )
    maps = chunks.mapInArrow(
        _chunk_maps(model),
        f"row bigint, key {kind}, n_bytes bigint, no int, head string, tokens bigint, state string",
    )
    texts = maps.groupBy("row", "key", "n_bytes").agg(
        F.array_sort(F.collect_list(F.struct("no", "head", "tokens", "state"))).alias("maps")
    )
    counted = texts.select("key", "n_bytes", "maps").mapInArrow(
        _composed(model), f"key {kind}, n_bytes bigint, n_tokens bigint"
    )
    return counted.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
