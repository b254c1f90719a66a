"""Exact deduplication by progressive refinement, in built-in functions only.

Texts are grouped by their length, then by a hash of their beginning, and only rows whose group
still has a second member are read in full for a SHA-256. Two scans of the texts, no shuffle of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolloom.llm.row_numbers import with_row_number
from rolloom.session import materialize

BLANKS = " \t\n\x0b\f\r"
PREFIX_CHARS = 256
LEAST_BITS, MOST_BITS = 1 << 23, 1 << 29  # of the survivors' bitmap: 1 MB to 64 MB in all
BITS_PER_GROUP = 16


def without_blanks(text: Column) -> Column:
    """NULL counts as empty. One byte-wise replacement per blank is cheaper than a regex."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


def bitmap_bits(groups: int) -> int:
    """The least power of two with BITS_PER_GROUP bits a group, from LEAST_BITS to MOST_BITS."""
    return min(max(1 << (BITS_PER_GROUP * groups).bit_length(), LEAST_BITS), MOST_BITS)


def _slot(hashed: Column, bits: int) -> Column:
    return F.pmod(hashed, F.lit(bits))


def _survivors(slim: DataFrame) -> tuple[DataFrame, int]:
    """A bitmap over the (length, prefix hash) groups that have two rows or more, and its bits.

    It is sized by the number of those groups. Rows (bucket, bits): at most MOST_BITS / 32768 = 16,384
    rows of 4 KB each, which bounds its broadcast. A false positive only has its text hashed for
    nothing; with more groups than MOST_BITS serves, more and more texts are, which costs less than
    moving them to a join.
    """
    sizes = slim.groupBy("_len").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    again = slim.join(sizes, "_len", "left_semi")
    groups = again.groupBy("_len", "_prefix").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    groups = materialize(groups.select(F.xxhash64("_len", "_prefix").alias("_h")), "dedup-groups")
    bits = bitmap_bits(groups.count())
    slots = groups.select(_slot(F.col("_h"), bits).alias("_s"))
    bitmap = slots.groupBy(F.bitmap_bucket_number("_s").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_s")).alias("_bits")
    )
    return materialize(bitmap, "dedup-bitmap"), bits


def _bit(bits: Column, position: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, 1)), 16, 10)
    return F.bit_get(byte.cast("bigint"), (position % 8).cast("int")) == 1


def _digests(df: DataFrame, key: str, text: str, digest_all: bool, *carried: str) -> DataFrame:
    """``(*carried, _key, _chars, _survives, _digest)`` per row; no row that has a copy fails to
    survive."""
    rows = df.select(
        *carried,
        F.col(key).alias("_key"),
        F.char_length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("_chars"),
        without_blanks(F.col(text)).alias("_body"),
    )
    length, prefix = F.octet_length("_body"), F.xxhash64(F.left("_body", F.lit(PREFIX_CHARS)))
    slim = materialize(rows.select(length.alias("_len"), prefix.alias("_prefix")), "dedup-slim")
    bitmap, bits = _survivors(slim)

    # second scan: the full hash, for rows whose bit is set
    rows = rows.withColumn("_s", _slot(F.xxhash64(length, prefix), bits))
    bucket = F.bitmap_bucket_number("_s") == F.col("_bucket")
    rows = rows.join(F.broadcast(bitmap), bucket, "left")
    survives = F.coalesce(_bit(F.col("_bits"), F.bitmap_bit_position("_s")), F.lit(False))
    full = F.sha2("_body", 256)
    rows = rows.select(
        *carried,
        "_key",
        "_chars",
        survives.alias("_survives"),
        (full if digest_all else F.when(survives, full)).alias("_digest"),
    )
    return materialize(rows, "dedup-digests")


def exact_dedup(
    df: DataFrame, key: str = "doc_id", text: str = "text", digest_all: bool = False
) -> DataFrame:
    """One row per input row: ``(key, keep_id, group_size, kept, n_chars, text_sha256)``.

    Texts are equal when they are identical without blanks (``[\\x20\\x09-\\x0D]``). Of equal texts
    the row with the most code points stays, then the smallest key. ``text_sha256`` (of the text
    without blanks) is NULL where the refinement never needed it, unless ``digest_all``.

    NULL text is an empty text and groups with other blank ones. A NULL key loses every tie. Rows
    that repeat a key with an equal text of the same length are one document: they share the
    decision, and all of them count in ``group_size``. No rows give no rows. Other columns of the
    input are not looked at.
    """
    rows = _digests(df, key, text, digest_all)
    best = F.min(F.struct(-F.col("_chars"), F.col("_key").isNull(), F.col("_key").alias("_key")))
    groups = (
        rows.filter("_survives")
        .groupBy("_digest")
        .agg(F.count(F.lit(1)).alias("_n"), best.alias("_best"), F.max("_chars").alias("_most"))
        .filter("_n > 1")
        .select("_digest", "_n", F.col("_best._key").alias("_keep"), "_most")
    )
    # only survivors are joined: the NULL digests of all others would meet in one task
    joined = rows.filter("_survives").join(groups, "_digest", "left")
    single = rows.filter("NOT _survives")
    joined = joined.unionByName(single, allowMissingColumns=True)
    grouped = F.col("_n").isNotNull()
    wins = F.col("_key").eqNullSafe(F.col("_keep")) & (F.col("_chars") == F.col("_most"))
    return joined.select(
        F.col("_key").alias(key),
        F.when(grouped, F.col("_keep")).otherwise(F.col("_key")).alias("keep_id"),
        F.coalesce("_n", F.lit(1)).cast("bigint").alias("group_size"),
        F.when(grouped, wins).otherwise(F.lit(True)).alias("kept"),
        F.col("_chars").alias("n_chars"),
        F.col("_digest").alias("text_sha256"),
    )


def drop_exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay, with their columns: exactly one of each group of equal texts.

    As in :func:`exact_dedup` the most code points win, then the smallest key; rows that repeat a key,
    or have none, are decided one by one, the last tie by row number. The rows are written once with
    their number.
    """
    numbered, row = with_row_number(df, "dedup-rows")
    rows = _digests(numbered, key, text, False, row).filter("_survives")
    best = F.min(F.struct(-F.col("_chars"), F.col("_key").isNull(), "_key", F.col(row).alias("_row")))
    stays = rows.groupBy("_digest").agg(best.alias("_best")).select(F.col("_best._row").alias("_stays"))
    gone = rows.select(F.col(row).alias("_gone"))
    gone = materialize(gone.join(stays, F.col("_gone") == F.col("_stays"), "left_anti"), "dedup-gone")
    # by sort-merge at every size: what is dropped grows with the table and is nothing to broadcast
    kept = numbered.join(gone.hint("merge"), F.col(row) == F.col("_gone"), "left_anti")
    return kept.drop(row)
