"""Token IDs in patched frame-of-reference blocks.

A shard file is a run of blocks, an index and a footer. A block holds up to 4,096 ids: their minimum
is subtracted, the differences are packed at the width that a percentile of them needs, and the
larger ones are stored whole in an exception list. The index tells where each block starts, so that
any range of ids is read without the blocks before it.

File layout, little-endian (fixed values of the format):
  "PFOR0001"
  block:  u32 minimum, u32 ids, u32 exceptions, u8 width,
          packed differences, u32 positions of exceptions, u32 their differences
  index:  u64 start of each block, i64 key of each document, u8 whether it has a key,
          u64 ids of each document
  footer: u64 start of the index, u64 blocks, u64 documents, u64 ids, "PFOR0001"
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rolloom.llm.arrow_words import lay_out, text_slices
from rolloom.llm.shared_files import commit, open_new, open_old, temporary_name
from rolloom.llm.word_memo import WordMemo
from rolloom.llm.worker import kept
from rolloom.operators.skew import running_sum

MAGIC = b"PFOR0001"
BLOCK_HEAD = "<IIIB"
FOOTER = "<QQQQ8s"
BLOCK_IDS = 4096
PERCENTILE = 90
SHARD_IDS = 1 << 22  # a shard is closed at the first document end behind so many ids
_STOPS = [".", ","]
# the split pattern cuts a full stop or comma off letters
_STOPPED = r"^[\x00\n]?\p{L}+[.,]\z"
_FIRST = "\0"  # put before the first word of a text
# a text that is not taken apart: other blanks, two in a row, one at the end, or the sign above
_ODD = (
    r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}"
    r"\x{3000}]|[ \n][ \n]|[ \n]\z"
)
_MARK = "Ġ"  # how byte-level pieces write a leading space


class ByteLevelEncoder:
    """Ids of whole texts as the tokenizers library gives them, as little-endian u32.

    Where the tokenizer splits as byte-level BPE does, a text falls apart before each space and line
    feed behind a non-blank. That is done on Arrow columns: texts are split, the words of many texts
    become one dictionary, only its entries are looked up in a bounded memo, and one gather lays their
    ids out again. A word that is not known is encoded by the library. Texts with other blanks, two
    blanks in a row or one at the end, a zero character or a special token's string go through the
    library as a whole, as does any other tokenizer.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        model = json.loads(self._tokenizer.to_str())
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        split = model.get("pre_tokenizer") or {}
        self._by_word = (
            model["model"]["type"] == "BPE"
            and model.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and split.get("use_regex")
            and not split.get("add_prefix_space")
        )
        vocabulary = self._tokenizer.get_vocab()
        self._starts_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self._starts_word[[i for piece, i in vocabulary.items() if piece.startswith(_MARK)]] = True
        self._stops = [*self._encode(_STOPS), b""]
        self._feed = self._encode(["\n"])[0]
        self._words: WordMemo[bytes] = WordMemo(self._encode_words, 400_000)

    def _encode(self, texts: list[str]) -> list[bytes]:
        encoded = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4").tobytes() for x in encoded]

    def _encode_lines(self, words: list[str]) -> list[bytes]:
        """Words that begin a line: in a few texts, a line each, parted at the line feeds again."""
        feed = np.frombuffer(self._feed, "<u4")
        single = [w for w in words if w]
        parts = [single[at : at + 1000] for at in range(0, len(single), 1000)]
        joined = self._tokenizer.encode_batch_fast(
            ["\n".join(part) for part in parts], add_special_tokens=False
        )
        found: dict[str, bytes] = {}
        for part, encoded in zip(parts, joined):
            ids = np.array(encoded.ids, "<u4")
            cut = np.flatnonzero(ids == feed[0])
            if len(feed) == 1 and len(cut) == len(part) - 1:
                raw, begin = ids.tobytes(), [0, *((cut + 1) * 4).tolist()]
                end = [*(cut * 4).tolist(), len(raw)]
                found.update(zip(part, [raw[i:j] for i, j in zip(begin, end)]))
        rest = [w for w in words if w not in found]
        found.update(zip(rest, self._encode(rest)))
        return [found[w] for w in words]

    def _join(self, words: list[str]) -> list[bytes]:
        """Words without blanks in a few texts: each begins at a piece with a leading space."""
        parts = [words[at : at + 1000] for at in range(0, len(words), 1000)]
        joined = self._tokenizer.encode_batch_fast(
            [" " + " ".join(part) for part in parts], add_special_tokens=False
        )
        out: list[bytes] = []
        for part, encoded in zip(parts, joined):
            ids = np.array(encoded.ids, "<u4")
            begin = np.flatnonzero(self._starts_word[ids])
            if len(begin) == len(part):
                raw, edge = ids.tobytes(), np.append(begin * 4, len(ids) * 4).tolist()
                out += [raw[i:j] for i, j in zip(edge, edge[1:])]
            else:  # not to be expected; the plain way is always right
                out += self._encode([" " + w for w in part])
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of words as :meth:`__call__` cuts them: the sign in front tells what a word follows."""
        lines = list({w[1:] for w in words if w[:1] in (_FIRST, "\n")})
        behind = [w for w in words if w[:1] not in (_FIRST, "\n")]
        first = dict(zip(lines, self._encode_lines(lines)))
        later = dict(zip(behind, self._join(behind)))
        return [
            first[w[1:]] if w[:1] == _FIRST
            else self._feed + first[w[1:]] if w[:1] == "\n"
            else later[w]
            for w in words
        ]

    def __call__(self, texts: pa.StringArray | Sequence[str | None]) -> list[bytes]:
        if not isinstance(texts, pa.Array):
            texts = pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        if not self._by_word:
            return self._encode(texts.to_pylist())
        odd = pc.match_substring_regex(texts, _ODD)
        for special in self._special:
            odd = pc.or_(odd, pc.match_substring(texts, special))
        whole = iter(self._encode(texts.filter(odd).to_pylist()))
        marked = pc.replace_substring(texts.filter(pc.invert(odd)), "\n", " \n")
        cut = pc.split_pattern(pc.binary_join_element_wise(_FIRST, marked, ""), " ")
        found = lay_out(cut, self._words, _STOPPED, _STOPS, self._stops)
        laid, edges = found.ids.tobytes(), (found.edges * 4).tolist()
        each = iter([laid[i:j] for i, j in zip(edges, edges[1:])])
        return [next(whole) if is_odd else next(each) for is_odd in odd.to_pylist()]


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    low = int(ids.min()) if len(ids) else 0
    rest = ids.astype(np.uint32) - np.uint32(low)
    width = 0
    if len(ids):
        rank = min(len(ids) - 1, int(np.ceil(len(ids) * percentile / 100)) - 1)
        width = int(np.partition(rest, rank)[rank]).bit_length()
    large = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    small = rest.copy()
    small[large] = 0
    bits = np.unpackbits(small.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    packed = np.packbits(bits[:, :width], bitorder="little")
    head = struct.pack(BLOCK_HEAD, low, len(ids), len(large), width)
    return head + packed.tobytes() + large.astype("<u4").tobytes() + rest[large].astype("<u4").tobytes()


def unpack_block(raw: bytes) -> np.ndarray:
    low, count, exceptions, width = struct.unpack_from(BLOCK_HEAD, raw)
    at = struct.calcsize(BLOCK_HEAD)
    size = (count * width + 7) // 8
    packed = np.frombuffer(raw, np.uint8, size, at)
    bits = np.zeros((count, 32), np.uint8)
    bits[:, :width] = np.unpackbits(packed, count=count * width, bitorder="little").reshape(count, width)
    rest = np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()
    positions = np.frombuffer(raw, "<u4", exceptions, at + size)
    rest[positions] = np.frombuffer(raw, "<u4", exceptions, at + size + 4 * exceptions)
    return rest + np.uint32(low)


class ShardWriter:
    def __init__(self, uri: str):
        self._file = open_new(uri)
        self._file.write(MAGIC)
        self._at = len(MAGIC)
        self._waiting: list[bytes] = []
        self._n_waiting = 0
        self._blocks: list[int] = []
        self._keys: list[int | None] = []
        self._lengths: list[int] = []
        self.n_ids = 0

    def add(self, key: int | None, ids: bytes) -> None:
        self._keys.append(key)
        self._lengths.append(len(ids) // 4)
        self._waiting.append(ids)
        self._n_waiting += len(ids) // 4
        self.n_ids += len(ids) // 4
        if self._n_waiting >= 16 * BLOCK_IDS:
            self._flush(self._n_waiting - self._n_waiting % BLOCK_IDS)

    def _flush(self, upto: int) -> None:
        ids = np.frombuffer(b"".join(self._waiting), "<u4")
        for begin in range(0, upto, BLOCK_IDS):
            block = pack_block(ids[begin : min(begin + BLOCK_IDS, upto)])
            self._blocks.append(self._at)
            self._file.write(block)
            self._at += len(block)
        self._waiting, self._n_waiting = [ids[upto:].tobytes()], len(ids) - upto

    def close(self) -> tuple[int, int, int]:
        """Documents, ids and bytes of the shard."""
        self._flush(self._n_waiting)
        index = b"".join(
            [
                np.array(self._blocks, "<u8").tobytes(),
                np.array([k or 0 for k in self._keys], "<i8").tobytes(),
                np.array([k is not None for k in self._keys], "u1").tobytes(),
                np.array(self._lengths, "<u8").tobytes(),
            ]
        )
        foot = struct.pack(FOOTER, self._at, len(self._blocks), len(self._keys), self.n_ids, MAGIC)
        self._file.write(index + foot)
        self._file.close()
        return len(self._keys), self.n_ids, self._at + len(index) + len(foot)


class ShardReader:
    def __init__(self, uri: str):
        self._file = open_old(uri)
        size = self._file.size()
        foot = struct.calcsize(FOOTER)
        self._file.seek(size - foot)
        index, blocks, docs, self.n_ids, magic = struct.unpack(FOOTER, self._file.read(foot))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no finished shard")
        self._file.seek(index)
        raw = self._file.read(size - foot - index)
        self._ends = np.append(np.frombuffer(raw, "<u8", blocks), index).astype(np.int64)
        at = 8 * blocks
        keys = np.frombuffer(raw, "<i8", docs, at).tolist()
        known = np.frombuffer(raw, "u1", docs, at + 8 * docs).tolist()
        self.keys = [k if has else None for k, has in zip(keys, known)]
        self.lengths = np.frombuffer(raw, "<u8", docs, at + 9 * docs).astype(np.int64)

    def block(self, number: int) -> np.ndarray:
        self._file.seek(int(self._ends[number]))
        return unpack_block(self._file.read(int(self._ends[number + 1] - self._ends[number])))

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the shard; only their blocks are read."""
        if not count:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK_IDS, (start + count - 1) // BLOCK_IDS
        ids = np.concatenate([self.block(n) for n in range(first, last + 1)])
        return ids[start - first * BLOCK_IDS :][:count]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(key, start in the shard, ids) of each document; blocks are read once, one after another."""
        start, number = 0, 0
        ids = np.zeros(0, np.uint32)
        for key, length in zip(self.keys, self.lengths.tolist()):
            parts = [ids]
            have = len(ids)
            while have < length:
                parts.append(self.block(number))
                have += len(parts[-1])
                number += 1
            if len(parts) > 1:
                ids = np.concatenate(parts)
            yield key, start, ids[:length]
            ids = ids[length:]
            start += length

    def close(self) -> None:
        self._file.close()


_WRITTEN = pa.schema(
    [
        ("shard_no", pa.int64()),
        ("name", pa.string()),
        ("temporary", pa.string()),
        ("n_docs", pa.int64()),
        ("n_ids", pa.int64()),
        ("n_bytes", pa.int64()),
    ]
)


def _writer(tokenizer: str, end_id: int | None, folder: str) -> Callable:
    end_mark = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = kept(("byte level", tokenizer), lambda: ByteLevelEncoder(tokenizer))
        part = TaskContext.get().partitionId()
        made: list[dict] = []
        shard: ShardWriter | None = None

        def close() -> None:
            docs, ids, size = shard.close()
            made[-1] |= {"n_docs": docs, "n_ids": ids, "n_bytes": size}

        for batch in batches:
            for at, end in text_slices(batch.column(1)):
                rows = batch.slice(at, end - at)
                for key, ids in zip(rows.column(0).to_pylist(), encode(rows.column(1))):
                    if shard is None:
                        number = part << 20 | len(made)
                        name = f"ids-{part:06d}-{len(made):06d}.pfor"
                        temporary = temporary_name(folder, name)
                        made.append({"shard_no": number, "name": name, "temporary": temporary})
                        shard = ShardWriter(temporary)
                    shard.add(key, ids + end_mark)
                    if shard.n_ids >= SHARD_IDS:
                        close()
                        shard = None
        if shard is not None:
            close()
        yield pa.RecordBatch.from_pylist(made, schema=_WRITTEN)

    return write


def write_token_blocks(
    df: DataFrame,
    folder: str,
    tokenizer: str,
    end_id: int | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode texts and write their ids, in ascending key order, as shards under ``folder``.

    Returns the manifest ``(shard_no, name, n_docs, n_ids, n_bytes, first_id)``. Texts are shuffled
    once, by key range, and encoded behind the shuffle. NULL texts are empty and hold the end id
    alone; NULL keys come first; rows that repeat a key are ordered by a hash of their text and all written.
    An empty table gives an empty manifest.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text"))
    place = ["key", F.xxhash64("text"), "text"]  # rows that share a key may go to several tasks
    rows = rows.repartitionByRange(tasks, *place[:2]).sortWithinPartitions(*place)
    files = rows.mapInArrow(
        _writer(tokenizer, end_id, folder),
        "shard_no bigint, name string, temporary string, n_docs bigint, n_ids bigint, "
        "n_bytes bigint",
    )
    manifest = commit(spark, files, folder)
    return running_sum(manifest, "shard_no", F.col("n_ids"), "first_id")


def read_token_blocks(manifest: DataFrame, folder: str) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32)`` of every document in the shards of a manifest.

    ``start`` counts the ids of all documents before it, ``ids_crc32`` is taken over the ids as
    little-endian unsigned 32-bit integers.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, first in zip(*(batch.column(c).to_pylist() for c in ("name", "first_id"))):
                shard = ShardReader(f"{folder}/{name}")
                rows = [
                    (key, first + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                    for key, start, ids in shard.documents()
                ]
                shard.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x, pa.int64()) for x in zip(*rows)],
                    ["key", "start", "n_tokens", "ids_crc32"],
                )

    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files = manifest.select("shard_no", "name", "first_id").repartition(tasks, "shard_no")
    return files.mapInArrow(read, "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
