"""Mixing sources to target weights with hash-threshold histograms, in built-in functions only.

Every document has a 60-bit hash. Words are summed by source and hash bucket, and the bucket in
which a source's budget ends is refined until its threshold is known bit by bit; documents are then
filtered by comparing their hash, and those of the boundary's key by a hash of their text. Nothing is sorted, and a rerun draws the same mix.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolloom.session import materialize

WORD = "[^\\x20\\x09-\\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
HASH_BITS = 60
LEVEL_BITS = 15  # a histogram has at most 2**15 buckets per source and level


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def hash60(key: Column, seed: int = 0) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("bigint")


def text_hash(text: Column, seed: int = 0) -> Column:
    """Tells the rows of one key apart."""
    return F.xxhash64(F.lit(seed), text).bitwiseAND(F.lit((1 << HASH_BITS) - 1))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """Adds ``target`` to (_source, source_size): shares by weight, none above MAX_EPOCHS sizes.

    Capping and resharing until none is above ends at one water level: sources whose cap is lowest
    for their weight stay at the cap, the others get level * weight. The level is found from running
    sums over the sources in that order. The table has one row per source, so its windows are small.
    """
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source"))
    listed = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("_rank", F.row_number().over(order) - 1)
    ranked = ranked.withColumn(
        "_w", F.get(listed, (F.col("_rank") % len(weights)).cast("int")).cast("bigint")
    ).withColumn("_cap", F.col("source_size") * MAX_EPOCHS)
    everything = Window.partitionBy(F.lit(0))
    before = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("_cap") / F.col("_w"), "_rank")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    zero = F.lit(0).cast("bigint")
    ranked = ranked.withColumns(
        {
            "_left": F.sum("source_size").over(everything)
            - F.coalesce(F.sum("_cap").over(before), zero),
            "_w_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), zero),
        }
    )
    # the first source in cap order that stays under its cap sets the level
    under = F.col("_left") * F.col("_w") <= F.col("_cap") * F.col("_w_left")
    first = F.min(
        F.when(under, F.struct(F.col("_cap") / F.col("_w"), "_rank", "_left", "_w_left"))
    ).over(everything)
    ranked = ranked.withColumn("_level", first)
    share = F.col("_level._left") * F.col("_w") / F.col("_level._w_left")
    return ranked.select(
        "_source",
        "source_size",
        F.least(F.col("_cap").cast("double"), share.cast("double")).alias("target"),
    )


def _thresholds(docs: DataFrame, budgets: DataFrame) -> DataFrame:
    """(_source, _threshold, _text_threshold): documents with a hash below the first, or with that
    hash and a text hash below the second, are taken once more.

    Level by level, only rows inside the boundary bucket are summed by their next bits, first of the
    hash, then of the text hash, which tells the rows of one key apart. In the last cell, which holds
    one document or equal ones, the nearer end is chosen.
    """
    none = F.lit(None).cast("bigint")
    state = budgets.select(
        "_source", none.alias("_hash_low"), none.alias("_text_low"), F.col("_extra").alias("_room")
    )
    levels = range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS)
    for column, bits_left in [(c, b) for c in ("_hash", "_text") for b in levels]:
        low = f"{column}_low"
        inside = docs.join(state, docs["_source"].eqNullSafe(state["_source"])).drop(
            state["_source"]
        )
        if column == "_text":
            inside = inside.filter(F.col("_hash") == F.col("_hash_low"))
        bucket = F.shiftright(column, bits_left)
        if bits_left + LEVEL_BITS < HASH_BITS:
            same = F.shiftright(column, bits_left + LEVEL_BITS) == F.shiftright(
                low, bits_left + LEVEL_BITS
            )
            inside = inside.filter(same)
        histogram = inside.groupBy("_source", bucket.alias("_bucket")).agg(
            F.sum("size").alias("_words"),
            F.first("_room").alias("_room"),
            F.first("_hash_low").alias("_hash_low"),
        )
        upto = (
            Window.partitionBy("_source")
            .orderBy("_bucket")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        histogram = histogram.withColumn("_sum", F.sum("_words").over(upto))
        over = F.col("_sum") > F.col("_room")
        found = histogram.groupBy("_source").agg(
            F.min(F.when(over, F.struct("_bucket", "_sum", "_words"))).alias("_edge"),
            F.max("_bucket").alias("_last"),
            F.first("_room").alias("_room"),
            F.first("_hash_low").alias("_hash_low"),
        )
        edge = F.shiftleft(F.col("_edge._bucket"), bits_left)
        room = F.col("_room") - (F.col("_edge._sum") - F.col("_edge._words"))
        if column == "_text" and bits_left == 0:
            nearer = F.when(room * 2 >= F.col("_edge._words"), edge + 1).otherwise(edge)
            found = found.select(
                "_source",
                F.col("_hash_low").alias("_threshold"),
                F.coalesce(nearer, F.col("_last") + 1).alias("_text_threshold"),
            )
        else:
            # no edge: everything fits, which only a budget of the whole source does
            edge = F.coalesce(edge, F.shiftleft(F.col("_last") + 1, bits_left))
            found = found.select(
                "_source",
                (edge if column == "_hash" else F.col("_hash_low")).alias("_hash_low"),
                (none if column == "_hash" else edge).alias("_text_low"),
                F.coalesce(room, F.lit(0.0)).alias("_room"),
            )
        state = materialize(found, "mix-level")
    return state


def mix_plan(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """The documents as (_key, _source, size, _hash, _text), and one row per source with its target,
    the whole passes over it and the hash thresholds of one more pass."""
    docs = materialize(
        df.select(
            F.col(key).alias("_key"),
            F.col(source).alias("_source"),
            n_words(F.col(text)).alias("size"),
            hash60(F.col(key), seed).alias("_hash"),
            text_hash(F.col(text), seed).alias("_text"),
        ),
        "mix-docs",
    )
    sizes = docs.groupBy("_source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size")))
    plan = plan.withColumn("_whole", F.coalesce(whole, F.lit(0)).cast("bigint"))
    plan = plan.withColumn("_extra", F.col("target") - F.col("_whole") * F.col("source_size"))
    plan = materialize(plan, "mix-plan")

    # empty documents cannot move a sum; a budget of nothing needs no threshold
    counted = docs.filter("size > 0").select("_source", "_hash", "_text", "size")
    threshold = _thresholds(counted, plan.filter("_extra > 0"))
    threshold = threshold.withColumnRenamed("_source", "_of")
    plan = plan.join(threshold, F.col("_source").eqNullSafe(F.col("_of")), "left").select(
        F.col("_source").alias("_mix_source"),
        "source_size",
        "target",
        F.col("_whole").alias("_mix_whole"),
        F.col("_threshold").alias("_mix_threshold"),
        F.col("_text_threshold").alias("_mix_text_threshold"),
    )
    return docs, materialize(plan, "mix-thresholds")


def _epochs(hashed: Column, text_hashed: Column) -> Column:
    below = hashed < F.col("_mix_threshold")
    within = (hashed == F.col("_mix_threshold")) & (text_hashed < F.col("_mix_text_threshold"))
    return F.col("_mix_whole") + F.coalesce(below | within, F.lit(False)).cast("bigint")


def mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    seed: int = 0,
) -> DataFrame:
    """``(key, size, source_size, target, epochs, taken)`` per row; ``taken`` = size * epochs.

    ``epochs`` is how often a document goes into the mix: whole passes over its source, plus one if
    its hash lies below the source's thresholds; never above MAX_EPOCHS.

    NULL text has size 0; a NULL source is a source of its own, last in order; rows that repeat a key
    share a hash, and where the budget ends among them a hash of their text decides: only rows with
    one key and one text are always taken together. Sources without words have target 0 and are not taken. No
    rows give no rows. Other columns of the input are not looked at.
    """
    docs, plan = mix_plan(df, key, text, source, weights, seed)
    rows = docs.join(plan, F.col("_source").eqNullSafe(F.col("_mix_source")))
    epochs = _epochs(F.col("_hash"), F.col("_text"))
    return rows.select(
        F.col("_key").alias(key),
        "size",
        "source_size",
        "target",
        epochs.alias("epochs"),
        (F.col("size") * epochs).alias("taken"),
    )


def draw_mix(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[int] = WEIGHTS,
    seed: int = 0,
) -> DataFrame:
    """The mix itself: the rows of ``df``, each as often as it is taken.

    A row compares its own hash with its source's threshold, so texts are not shuffled for it.
    """
    _, plan = mix_plan(df, key, text, source, weights, seed)
    plan = plan.select("_mix_source", "_mix_whole", "_mix_threshold", "_mix_text_threshold")
    taken = df.join(plan, F.col(source).eqNullSafe(F.col("_mix_source")))
    epochs = _epochs(hash60(F.col(key), seed), text_hash(F.col(text), seed))
    copies = F.sequence(F.lit(1).cast("bigint"), epochs)
    return taken.withColumn(
        "_mix_copy", F.explode(F.when(epochs > 0, copies))
    ).select(*[F.col(f"`{name}`") for name in df.columns])
