"""Words of many texts as Arrow columns: looked up once per dictionary entry, laid out by one gather."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from rolloom.llm.word_memo import WordMemo

SLICE_BYTES = 1 << 22  # of texts that are words at once


def text_slices(texts: pa.StringArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows with a bounded number of bytes; a row above the bound is a run of its own."""
    total, begin = 0, 0
    for at, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if total and total + size > limit:
            yield begin, at
            begin, total = at, 0
        total += size
    if begin < len(texts):
        yield begin, len(texts)


class LaidOut(NamedTuple):
    ids: np.ndarray  # of all texts, one behind the other
    edges: np.ndarray  # where each text begins and the last one ends
    values: list[bytes]  # of the different words
    word: np.ndarray  # for every word of the texts its place among the different ones
    word_edges: np.ndarray  # as edges, in words


def lay_out(
    cut: pa.ListArray, memo: WordMemo[bytes], stopped: str, stops: list[str], tails: list[bytes]
) -> LaidOut:
    """Ids (u32) of texts that are lists of words.

    A word that matches ``stopped`` ends in one of ``stops``: it is looked up without it, and the ids
    in ``tails`` follow. So a word is made once for all its marks; ``tails`` has one entry more than
    ``stops``, the empty one.
    """
    words = cut.flatten().dictionary_encode()
    different = words.dictionary
    has_stop = pc.match_substring_regex(different, stopped)
    bare = pc.utf8_slice_codeunits(different, 0, stop=-1)
    stems = pc.if_else(has_stop, bare, different).dictionary_encode()
    last = pc.index_in(pc.utf8_slice_codeunits(different, -1), pa.array(stops, pa.string()))
    tail = pc.fill_null(pc.if_else(has_stop, last, len(stops)), len(stops))
    names = stems.dictionary.to_numpy(zero_copy_only=False).tolist()
    values = list(map(memo.covering(set(names)).__getitem__, names))
    made = pc.binary_join_element_wise(
        pa.array(values, pa.large_binary()).take(stems.indices),
        pa.array(tails, pa.large_binary()).take(tail),
        pa.scalar(b"", pa.large_binary()),
    )
    # one copy of bytes per word lays out the ids; its offsets are where the words begin
    laid = made.take(words.indices)
    begin = np.zeros(1, np.int64)
    if len(laid):
        begin = np.frombuffer(laid.buffers()[1], np.int64, len(laid) + 1, 8 * laid.offset)
    raw = laid.buffers()[2] if begin[-1] > begin[0] else b""
    ids = np.frombuffer(raw, "<u4", (begin[-1] - begin[0]) >> 2, begin[0])
    edges = (begin - begin[0]) >> 2
    word = stems.indices.to_numpy()[words.indices.to_numpy()]
    word_edges = cut.offsets.to_numpy() - cut.offsets[0].as_py()
    return LaidOut(ids, edges[word_edges], values, word, word_edges)
