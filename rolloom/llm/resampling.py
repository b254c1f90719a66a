"""Importance resampling towards a target, over hashed n-grams.

In a task a text is translated by a table of 256 bytes that lower-cases A-Z and blanks what separates
words, and split; the CRC32 of a run of words seeds that of the run that is one word longer. Features
fall into a fixed number of buckets, counted in a Counter per task and summed by Spark. The gains of
the buckets are a table of fixed size; it goes to the tasks of the second pass, which weigh each text.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.row_numbers import with_positions, with_row_number

BUCKETS = 10_000
LONGEST = 2  # words of a feature
SCALE = 1000
SEED = 7
MIN_WORDS = 20
PERCENT = 25
_CHUNK = 1 << 20  # bytes of a text that are words at a time
_BLANK = 0x20


def _translated(byte: int) -> int:
    if 0x41 <= byte <= 0x5A:
        return byte + 0x20
    word = 0x30 <= byte <= 0x39 or 0x61 <= byte <= 0x7A or byte >= 0x80
    return byte if word else _BLANK


TABLE = bytes(map(_translated, range(256)))


def word_chunks(raw: bytes) -> Iterator[list[bytes]]:
    """Words of a text, a bounded number of bytes at a time; no word is cut."""
    clean = raw.translate(TABLE)
    at = 0
    while at < len(clean):
        to = at + _CHUNK
        to = clean.find(b" ", to) if to < len(clean) else -1
        to = len(clean) if to < 0 else to
        yield clean[at:to].split()
        at = to


def feature_chunks(raw: bytes, buckets: int, longest: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the features that end in them), chunk by chunk."""
    carried: list[bytes] = []
    for new in word_chunks(raw):
        if not new:
            continue
        words = carried + new
        behind = [b" " + w for w in words[1:]]
        hashes = list(map(crc32, words))
        found = hashes[len(carried) :]
        for length in range(2, longest + 1):
            hashes = list(map(crc32, behind[length - 2 :], hashes))
            found += hashes[max(0, len(carried) - length + 1) :]
        yield len(new), np.array(found, np.uint32) % buckets
        carried = words[max(0, len(words) - longest + 1) :]


def _counter(buckets: int, longest: int) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[int] = Counter()
        for batch in batches:
            for raw in batch.column(0):
                if raw.is_valid:
                    for _, found in feature_chunks(raw.as_py(), buckets, longest):
                        counts.update(found.tolist())
        columns = [pa.array(list(x), pa.int64()) for x in (counts.keys(), counts.values())]
        yield pa.RecordBatch.from_arrays(columns, ["bucket", "n"])

    return count


def bucket_counts(
    df: DataFrame, text: str = "text", buckets: int = BUCKETS, longest: int = LONGEST
) -> np.ndarray:
    """Features of all texts per bucket: as many numbers as there are buckets reach the driver."""
    raw = df.select(F.col(text).cast("binary").alias("raw"))
    counted = raw.mapInArrow(_counter(buckets, longest), "bucket bigint, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in counted.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def bucket_gains(all_counts: np.ndarray, target_counts: np.ndarray) -> np.ndarray:
    """Scaled logarithm of how much likelier a bucket is in the target, rounded down."""
    s, t, size = all_counts.astype(float), target_counts.astype(float), float(len(all_counts))
    ratio = ((t + 1) * (s.sum() + size)) / ((s + 1) * (t.sum() + size))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def _weigher(gains: np.ndarray, longest: int) -> Callable:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(1):
                n_words = n_features = total = 0
                if raw.is_valid:
                    for words, found in feature_chunks(raw.as_py(), len(gains), longest):
                        n_words += words
                        n_features += len(found)
                        total += int(gains[found].sum())
                rows.append((n_words, n_features, total // n_features if n_features else 0))
            columns = [pa.array(x, pa.int64()) for x in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns], ["key", "n_words", "n_features", "weight"]
            )

    return weigh


def luck(key: Column, seed: int = SEED) -> Column:
    """Scaled Gumbel noise from the key alone, rounded down; a NULL key counts as an empty one."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1.0 * SCALE) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(
    df: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    target_text: str = "text",
    percent: int = PERCENT,
    min_words: int = MIN_WORDS,
    buckets: int = BUCKETS,
    longest: int = LONGEST,
    seed: int = SEED,
) -> DataFrame:
    """``(key, n_words, n_features, weight, score, rank)`` per row of ``df``.

    ``weight`` is the mean gain of a text's features, rounded down, ``score`` adds noise drawn from the
    key. Of the N rows with ``min_words`` words or more, the ``percent * N // 100`` highest scores are
    drawn and ranked from 1; ``rank`` is NULL for all others. Ties go to the smaller key, NULL keys
    last; rows equal in score and key come in the order of the scan.

    NULL and wordless texts have no features and weight 0. Without target texts every gain compares
    with an even spread. No rows give no rows. Other columns of the inputs are not looked at.
    """
    gains = bucket_gains(
        bucket_counts(df, text, buckets, longest),
        bucket_counts(target, target_text, buckets, longest),
    )
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("binary").alias("raw"))
    weighed = rows.mapInArrow(
        _weigher(gains, longest), f"key {kind}, n_words bigint, n_features bigint, weight bigint"
    )
    scored = weighed.withColumn("score", F.col("weight") + luck(F.col("key"), seed))
    scored, row = with_row_number(scored, "scores")
    able = scored.filter(F.col("n_words") >= min_words)
    placed = with_positions(
        able, [F.col("score").desc(), F.col("key").asc_nulls_last(), row], name="scores-ordered"
    )
    drawn = F.col("_at") < F.expr(f"({percent} * _n) div 100")
    ranked = placed.withColumn("rank", F.when(drawn, F.col("_at") + 1))
    rest = scored.filter(F.col("n_words") < min_words)
    rest = rest.withColumn("rank", F.lit(None).cast("bigint"))
    out = ["key", "n_words", "n_features", "weight", "score", "rank"]
    found = ranked.select(out).unionByName(rest.select(out))
    return found.withColumnRenamed("key", key)
