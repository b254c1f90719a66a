"""SentencePiece models run by the tokenizers library, with parity checked against sentencepiece.

The model protobuf is parsed and its parts are rebuilt: the normaliser (character map, extra blanks,
dummy prefix, blanks as U+2581), the pieces with their scores (Unigram) or as merges ranked by score
(BPE), the fallback to byte pieces, and the decoder. Batches are encoded by the library's threads.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2
from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from rolloom.llm.arrow_words import lay_out, text_slices
from rolloom.llm.word_memo import WordMemo
from rolloom.llm.worker import kept

BLANK = "▁"
THREADS = 2
_SLICE = 256  # lists decoded at once
# a text that does not fall apart at single blanks, or an empty one
_ODD = r"\A\z|  |\A | \z|" + BLANK
_NORMAL, _UNKNOWN, _USER, _UNUSED = 1, 2, 4, 5  # piece types of the protobuf


def read_model(path: str) -> model_pb2.ModelProto:
    proto = model_pb2.ModelProto()
    with open(path, "rb") as file:
        proto.ParseFromString(file.read())
    return proto


def _merges(pieces: Sequence[tuple[str, float]]) -> list[tuple[str, str]]:
    """All ways to put a piece together, best score first.

    sentencepiece joins the best pair, the leftmost of equals. Pairs of equal score are ranked by a
    longer left part, so that a run of one character grows from its left end.
    """
    known = {piece for piece, _ in pieces}
    ranked = [
        (-score, -cut, order, piece[:cut], piece[cut:])
        for order, (piece, score) in enumerate(pieces)
        for cut in range(1, len(piece))
        if piece[:cut] in known and piece[cut:] in known
    ]
    return [(left, right) for *_, left, right in sorted(ranked)]


def build_normalizer(spec: model_pb2.NormalizerSpec) -> normalizers.Normalizer:
    steps: list[normalizers.Normalizer] = []
    if spec.precompiled_charsmap:
        steps.append(normalizers.Precompiled(spec.precompiled_charsmap))
    if spec.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Strip()]
    if spec.add_dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    if spec.escape_whitespaces:
        steps.append(normalizers.Replace(" ", BLANK))
    return normalizers.Sequence(steps)


def build_tokenizer(proto: model_pb2.ModelProto) -> Tokenizer:
    """The model without its normaliser, which :func:`build_normalizer` gives."""
    pieces = [(p.piece, p.score) for p in proto.pieces]
    unknown = next((i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN), None)
    fallback = proto.trainer_spec.byte_fallback
    if proto.trainer_spec.model_type == model_pb2.TrainerSpec.UNIGRAM:
        model = models.Unigram(pieces, unk_id=unknown, byte_fallback=fallback)
    elif proto.trainer_spec.model_type == model_pb2.TrainerSpec.BPE:
        usable = [(p.piece, p.score) for p in proto.pieces if p.type in (_NORMAL, _USER, _UNUSED)]
        model = models.BPE(
            vocab={piece: i for i, (piece, _) in enumerate(pieces)},
            merges=_merges(usable),
            unk_token=None if unknown is None else pieces[unknown][0],
            fuse_unk=True,
            byte_fallback=fallback,
        )
    else:
        raise ValueError("only Unigram and BPE models are rebuilt")
    tokenizer = Tokenizer(model)
    user = [p.piece for p in proto.pieces if p.type == _USER]
    tokenizer.add_tokens([AddedToken(x, normalized=False) for x in user])
    steps = [decoders.Replace(BLANK, " "), decoders.ByteFallback(), decoders.Fuse()]
    if proto.normalizer_spec.add_dummy_prefix:
        steps.append(decoders.Strip(" ", 1, 0))
    tokenizer.decoder = decoders.Sequence(steps)
    return tokenizer


class Differing(bytes):
    """Ids of the rebuilt tokenizer that are not those of sentencepiece."""


class SentencePieceCodec:
    """Encodes and decodes batches with the rebuilt tokenizer; sentencepiece confirms its ids.

    No piece of a common model holds a blank behind another character. Such a text falls apart before
    each run of blanks, and each segment is encoded by both libraries once. For other models whole
    texts are.
    """

    def __init__(self, path: str, threads: int = THREADS):
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        proto = read_model(path)
        self._threads = threads
        self._normalizer = build_normalizer(proto.normalizer_spec)
        self._tokenizer = build_tokenizer(proto)
        self._library = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.normalizer_spec
        identity = not spec.precompiled_charsmap and not spec.remove_extra_whitespaces
        self._by_segment = (
            identity
            and spec.add_dummy_prefix
            and spec.escape_whitespaces
            and not any(p.type == _USER for p in proto.pieces)
            and not any(BLANK in p.piece.lstrip(BLANK) for p in proto.pieces if p.type == _NORMAL)
        )
        self._starts = np.array([p.piece.startswith(BLANK) for p in proto.pieces])
        if self._by_segment:
            self._tokenizer.pre_tokenizer = pre_tokenizers.Split(
                Regex(f"{BLANK}+[^{BLANK}]*"), "isolated"
            )
        # marks that no piece joins to a letter before them: a word and such a mark are apart
        normal = [p.piece for p in proto.pieces if p.type == _NORMAL]
        self._stem = self._library.encode("a")
        self._stops: list[str] = []
        self._tails: list[bytes] = []
        for mark in ".,":
            apart = not any(re.search(rf"[^\W\d_]\{mark}", piece) for piece in normal)
            ours = self._backend([BLANK + "a" + mark])[0]
            if apart and ours == self._library.encode("a" + mark):
                self._stops.append(mark)
                self._tails.append(np.array(ours[len(self._stem) :], "<i4").tobytes())
        self._stopped = rf"^\p{{L}}+[{''.join(self._stops)}]\z" if self._stops else r"^\b$"
        self._memo: WordMemo[bytes] = WordMemo(self._segments, 50_000)
        self._words: WordMemo[bytes] = WordMemo(
            lambda words: self._segments([BLANK + w for w in words]), 400_000
        )

    def _backend(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _confirmed(ours: list[int], theirs: list[int]) -> bytes:
        raw = np.array(ours, "<i4").tobytes()
        return raw if ours == theirs else Differing(raw)

    def _joined(self, segments: list[str]) -> Iterator[bytes | None]:
        """Ids of segments with one leading blank, a thousand in one text: each begins at a piece with
        a leading blank. None where that does not hold. Both libraries are compared text by text, and
        word by word only where they differ."""
        for at in range(0, len(segments), 1000):
            part = segments[at : at + 1000]
            text = "".join(part)
            ours = np.array(self._backend([text])[0], "<i4")
            theirs = np.array(self._library.encode(text[1:], num_threads=self._threads), "<i4")
            edges = [np.append(np.flatnonzero(self._starts[x]), len(x)).tolist() for x in (ours, theirs)]
            if any(len(edge) != len(part) + 1 for edge in edges):
                yield from [None] * len(part)
                continue
            raw = ours.tobytes()
            ids = [raw[4 * i : 4 * j] for i, j in zip(edges[0], edges[0][1:])]
            if not np.array_equal(ours, theirs):
                raw = theirs.tobytes()
                other = [raw[4 * i : 4 * j] for i, j in zip(edges[1], edges[1][1:])]
                ids = [a if a == b else Differing(a) for a, b in zip(ids, other)]
            yield from ids

    def _segments(self, segments: list[str]) -> list[bytes]:
        """Segments, each a run of blanks with what follows, encoded by both libraries."""
        single = [s for s in segments if len(s) > 1 and BLANK not in s[1:]]
        found = dict(zip(single, self._joined(single)))
        rest = [s for s in segments if found.get(s) is None]
        theirs = self._library.encode(["a" + s for s in rest], num_threads=self._threads)
        for segment, ours, ids in zip(rest, self._backend(rest), theirs):
            found[segment] = self._confirmed(ours, ids[len(self._stem) :])
        return [found[s] for s in segments]

    def encode_checked(
        self, texts: pa.StringArray | Sequence[str]
    ) -> tuple[list[bytes], list[int]]:
        """Ids of each text as little-endian i32, and how many of its words (of the whole text, for
        models whose texts do not fall apart) sentencepiece encodes in another way."""
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not self._by_segment:
            plain = texts.to_pylist()
            normal = [self._normalizer.normalize_str(x) if x else "" for x in plain]
            theirs = self._library.encode(plain, num_threads=self._threads)
            raws = list(map(self._confirmed, self._backend(normal), theirs))
            return raws, [int(type(x) is Differing) for x in raws]
        odd = pc.match_substring_regex(texts, _ODD)
        cut = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        found = lay_out(cut, self._words, self._stopped, self._stops, [*self._tails, b""])
        differs = np.array([type(x) is Differing for x in found.values], np.int64)
        counts = np.append(0, np.cumsum(differs[found.word]))[found.word_edges]
        laid, edges = found.ids.tobytes(), (found.edges * 4).tolist()
        each = zip([laid[i:j] for i, j in zip(edges, edges[1:])], np.diff(counts).tolist())
        # blanks in runs, at an end, or written as the model's own sign
        runs = [
            re.findall(f"{BLANK}+[^{BLANK}]*", BLANK + x.replace(" ", BLANK)) if x else []
            for x in texts.filter(odd).to_pylist()
        ]
        segments = self._memo.covering({s for run in runs for s in run})
        whole = iter(
            [
                (b"".join(parts), sum(type(x) is Differing for x in parts))
                for run in runs
                for parts in [[segments[s] for s in run]]
            ]
        )
        rows = [next(whole) if is_odd else next(each) for is_odd in odd.to_pylist()]
        return [raw for raw, _ in rows], [n for _, n in rows]

    def encode(self, texts: pa.StringArray | Sequence[str]) -> list[bytes]:
        return self.encode_checked(texts)[0]

    def returns(self, texts: Sequence[str], raws: list[bytes]) -> list[bool]:
        """Whether the ids of each text, decoded as one list, are the text. A text with U+2581 is not:
        the sign is a blank to the model."""
        decoded = self.decode([np.frombuffer(x, "<i4").tolist() for x in raws])
        return [a == b for a, b in zip(decoded, texts)]

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self._tokenizer.decode_batch(ids, skip_special_tokens=True)


def _encoder(model: str, threads: int, text: int, carried: list[int]) -> Callable:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("codec", model, threads), lambda: SentencePieceCodec(model, threads))
        for batch in batches:
            for at, end in text_slices(batch.column(text)):
                rows = batch.slice(at, end - at)
                raws, differing = codec.encode_checked(rows.column(text))
                edges = np.cumsum([0, *(len(x) // 4 for x in raws)]).astype(np.int32)
                flat = pa.array(np.frombuffer(b"".join(raws), "<i4"))
                listed = pa.ListArray.from_arrays(pa.array(edges), flat)
                rows = rows.select(carried)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, listed, pa.array(differing, pa.int64())],
                    [*rows.schema.names, "_ids", "_differing"],
                )

    return encode


def encode_texts(
    df: DataFrame,
    model: str,
    text: str = "text",
    out: str = "ids",
    differing: str | None = None,
    threads: int = THREADS,
    keep_text: bool = True,
) -> DataFrame:
    """Adds ``out``, the ids of each text by the rebuilt tokenizer, without special pieces.

    NULL and empty texts have no ids. Every row stays, other columns as they are; without
    ``keep_text`` the text does not come back from the workers. ``differing`` names a column for the
    number of words of the text that sentencepiece encodes in another way.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    rows = df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)])
    # the text is told by its place: as a column of its own it would be sent and held twice
    place = df.columns.index(text)
    carried = [i for i in range(len(names)) if keep_text or i != place]
    fields = [f"{names[i]} {df.schema.fields[i].dataType.simpleString()}" for i in carried]
    schema = ", ".join([*fields, "_ids array<int>", "_differing bigint"])
    found = rows.mapInArrow(_encoder(model, threads, place, carried), schema)
    columns = [
        F.col(names[i]).alias(df.columns[i])
        for i in carried
        if df.columns[i] not in (out, differing)
    ]
    columns.append(F.col("_ids").alias(out))
    if differing is not None:
        columns.append(F.col("_differing").alias(differing))
    return found.select(*columns)


def decode_ids(
    df: DataFrame, model: str, ids: str = "ids", out: str = "text", threads: int = THREADS
) -> DataFrame:
    """Adds ``out``, the text of each list of ids; NULL stays NULL, no ids give an empty text."""

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = kept(("codec", model, threads), lambda: SentencePieceCodec(model, threads))
        for lists in batches:
            parts: list[str | None] = []
            for at in range(0, len(lists), _SLICE):
                part = lists.iloc[at : at + _SLICE]
                texts = iter(codec.decode([x.tolist() for x in part if x is not None]))
                parts += [None if x is None else next(texts) for x in part]
            yield pd.Series(parts, dtype=object)

    return df.withColumn(out, decode(F.col(ids)))


def _round_trip(model: str, threads: int) -> Callable:
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = kept(("codec", model, threads), lambda: SentencePieceCodec(model, threads))
        for batch in batches:
            for at, end in text_slices(batch.column(1)):
                rows = batch.slice(at, end - at)
                texts = pc.fill_null(rows.column(1), "")
                raws, differing = codec.encode_checked(texts)
                same = codec.returns(texts.to_numpy(zero_copy_only=False), raws)
                yield pa.RecordBatch.from_arrays(
                    [
                        rows.column(0),
                        pa.array([len(x) // 4 for x in raws], pa.int64()),
                        pa.array([zlib.crc32(x) for x in raws], pa.int64()),
                        pa.array(same),
                        pa.array(differing, pa.int64()),
                    ],
                    ["key", "n_tokens", "ids_crc32", "round_trip", "differing"],
                )

    return check


def round_trip(
    df: DataFrame, model: str, key: str = "doc_id", text: str = "text", threads: int = THREADS
) -> DataFrame:
    """``(key, n_tokens, ids_crc32, round_trip, differing)`` per row: texts encoded and decoded again.

    ``ids_crc32`` is taken over the ids as little-endian 32-bit integers, ``round_trip`` tells whether
    the decoded ids are the text (false for texts with U+2581, which is a blank to the model), and
    ``differing`` counts the words that sentencepiece encodes in another way. NULL is an empty text: no
    ids, and round_trip true. Every row is there once, whatever its key. Other columns are not looked at.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    found = rows.mapInArrow(
        _round_trip(model, threads),
        f"key {kind}, n_tokens bigint, ids_crc32 bigint, round_trip boolean, differing bigint",
    )
    return found.withColumnRenamed("key", key)
