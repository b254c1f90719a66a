"""SimHash near-duplicates through a grid over per-segment bit counts.

A fingerprint is mapped to the bit counts of its 2-bit segments. The Manhattan distance between two
such vectors never exceeds the Hamming distance of the fingerprints, so a range join on a grid of
count vectors finds every candidate, and the fingerprints then decide. With up to 3 differing bits
one half of the vector differs by 1 at most: each half is its own grid, whose cell is the half's
vector; a fingerprint stands in its own cell and in those one count above it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.llm.components import component_minimum
from rolloom.llm.row_numbers import with_row_number
from rolloom.session import materialize

SHINGLE_WORDS = 3
SEED = 42
MAX_DISTANCE = 3
HOT_CELL = 8192  # a cell with more fingerprints is compared in tiles of this size
_BLOCK = 1 << 16
_EVEN_BITS = 0x5555555555555555


def simhash(text: str | None) -> int:
    """The 64-bit fingerprint of one text, as a signed integer; 0 without words."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z and the six ASCII blanks
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(lengths + 1) - 1
        first = (ends - lengths)[: 1 - SHINGLE_WORDS].tolist()
        last = ends[SHINGLE_WORDS - 1 :].tolist()
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[i:j], SEED) for i, j in zip(first, last)]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _BLOCK):
        block = np.array(hashes[at : at + _BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(x) for x in texts], dtype="int64")


def _cells(nodes: DataFrame) -> DataFrame:
    """(cell, up, fp): each fingerprint in its own cell of both halves, and in the cells above."""
    # every 2-bit field of _e holds the number of its set bits, 0 to 2: low and high bit of the sum
    packed = (
        f"((fp ^ shiftrightunsigned(fp, 1)) & {_EVEN_BITS}L)"
        f" | (fp & shiftleft(fp, 1) & {~_EVEN_BITS}L)"
    )
    rows = nodes.selectExpr("fp", f"{packed} AS _e").selectExpr(
        "fp",
        "explode(array(named_struct('half', 0L, 'c', _e & 4294967295L), "
        "named_struct('half', 1L, 'c', shiftrightunsigned(_e, 32)))) AS _h",
    )
    rows = rows.selectExpr("fp", "shiftleft(_h.half, 32) | _h.c AS home", "_h.c AS c")
    above = (
        "transform(filter(sequence(0, 15), i -> (shiftright(c, 2 * i) & 3) < 2), "
        "i -> named_struct('cell', home + shiftleft(1L, 2 * i), 'up', true))"
    )
    own = "array(named_struct('cell', home, 'up', false))"
    return rows.selectExpr("fp", f"inline(concat({own}, {above}))").select("cell", "up", "fp")


def _tiled(cells: DataFrame) -> DataFrame:
    """Adds ``tile``. A cell with more than HOT_CELL fingerprints is cut into blocks by hash: its own
    fingerprints, and apart from them those that stand in it from cells below. Own blocks meet each
    other in tiles, and every block from below meets the own ones; blocks from below never meet, as
    only an own fingerprint makes a cell worth comparing. So what stands in a cell with one fingerprint
    of its own is dealt out once, and a cell without any is left out."""
    sizes = cells.groupBy("cell").agg(
        F.count_if(~F.col("up")).alias("own"), F.count_if("up").alias("others")
    )
    hot = sizes.filter(F.col("own") + F.col("others") > HOT_CELL).selectExpr(
        "cell",
        f"int(ceil(own / {HOT_CELL})) AS own_parts",
        f"int(ceil(others / {HOT_CELL})) AS other_parts",
    )
    hot = materialize(hot, "hot-cells")  # at most 34 * fingerprints / HOT_CELL rows
    rows = cells.join(hot, "cell", "left").filter("own_parts IS NULL OR own_parts > 0")
    parts = "IF(up, other_parts, own_parts)"
    rows = rows.withColumn("block", F.expr(f"int(pmod(xxhash64(fp), {parts}))"))
    among_own = "transform(sequence(0, own_parts - 1), k -> least(k, block) * own_parts + greatest(k, block))"
    from_below = "own_parts * own_parts + block * own_parts"
    with_own = f"transform(sequence(0, own_parts - 1), k -> {from_below} + k)"
    to_others = (
        "IF(other_parts > 0, transform(sequence(0, greatest(other_parts, 1) - 1), "
        "u -> own_parts * own_parts + u * own_parts + block), CAST(array() AS array<int>))"
    )
    tiles = (
        f"CASE WHEN own_parts IS NULL THEN array(0) WHEN up THEN {with_own} "
        f"ELSE concat({among_own}, {to_others}) END"
    )
    return rows.selectExpr("cell", f"explode({tiles}) AS tile", "up", "fp")


def _forest(prints: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the links among ``prints``: each is reached once, from one parent."""
    parents, children = [], []
    rest = prints
    while len(rest) > 1:
        frontier, rest = rest[:1], rest[1:]
        while len(frontier) and len(rest):
            width = max(1, (1 << 21) // len(rest))
            now, frontier = frontier[:width], frontier[width:]
            near = np.bitwise_count(now[:, None] ^ rest[None, :]) <= MAX_DISTANCE
            hit = near.any(axis=0)
            if hit.any():
                parents.append(now[near[:, hit].argmax(axis=0)])
                children.append(rest[hit])
                frontier = np.concatenate([frontier, rest[hit]])
                rest = rest[~hit]
    return parents, children


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _cell_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside each cell and tile; the rows come sorted by them, a run may span batches."""

    def columns(batch):
        return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in ("cell", "tile", "up", "fp"))

    def links(cell, tile, up, fp):
        if not len(cell):
            return None
        edge = np.flatnonzero((cell[1:] != cell[:-1]) | (tile[1:] != tile[:-1])) + 1
        begin, end = np.append(0, edge), np.append(edge, len(cell))
        own = np.add.reduceat(~up.astype(bool), begin, dtype=np.int64)
        a, b = [], []
        for i in np.flatnonzero((own > 0) & (end - begin > 1)):
            parents, children = _forest(np.unique(fp[begin[i] : end[i]].view(np.uint64)))
            a += parents
            b += children
        if not a:
            return None
        pair = [np.concatenate(x).view(np.int64) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pair], schema=_LINKS)

    kept: list[tuple] = []  # batches of a run that has not ended
    for batch in batches:
        if not batch.num_rows:
            continue
        now = columns(batch)
        same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
        begin = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
        if begin == 0 and kept and (kept[-1][0][-1], kept[-1][1][-1]) == (now[0][0], now[1][0]):
            kept.append(now)
            continue
        parts = [*kept, tuple(x[:begin] for x in now)]
        found = links(*[np.concatenate(x) for x in zip(*parts)])
        kept = [tuple(x[begin:] for x in now)]
        if found is not None:
            yield found
    if kept:
        found = links(*[np.concatenate(x) for x in zip(*kept)])
        if found is not None:
            yield found


def near_links(nodes: DataFrame) -> DataFrame:
    """``(a, b)``: links that connect what 3 or fewer differing bits connect, for distinct ``fp``.

    Every link found is a true one; of the links inside one cell only as many are kept as connect
    the same fingerprints, so a dense family of n gives at most n - 1 of them per cell.
    """
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = _tiled(_cells(nodes)).repartition(tasks, "cell", "tile")
    rows = rows.sortWithinPartitions("cell", "tile")
    return rows.mapInArrow(_cell_links, "a bigint, b bigint")


def simhash_groups(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id)`` per row; component_id is the smallest key reachable.

    Words are runs of non-blanks after lower-casing A-Z; shingles have three words, a shorter text is
    one shingle. NULL, empty and blank texts have fingerprint zero and are linked like any other.
    Rows with one fingerprint are one group without being compared. NULL keys never win, and rows
    that repeat a key each have their own fingerprint and group. No rows give no rows.
    """
    prints = materialize(
        df.select(F.col(key).alias("_key"), simhash_column(F.col(text)).alias("fp")), "prints"
    )
    nodes = prints.groupBy("fp").agg(F.min("_key").alias("min_id"))
    nodes = materialize(nodes, "print-nodes")
    found = component_minimum(nodes.withColumnRenamed("fp", "node"), near_links(nodes.select("fp")))
    found = materialize(found, "print-groups").withColumnRenamed("node", "fp")
    return prints.join(found, "fp").select(
        F.col("_key").alias(key),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def drop_near_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: of each group the one with the smallest key, for unique keys.

    Rows are looked up by key. Where a key stands on several texts, a row that stays in its group
    keeps all of them, so that no group is lost whole; :func:`keep_one_of_each_group` decides per row.
    """
    groups = simhash_groups(df, key, text)
    stays = F.col(key).eqNullSafe(F.col("component_id"))
    gone = groups.groupBy(F.col(key).alias("_gone_key")).agg(F.bool_or(stays).alias("_stays"))
    gone = materialize(gone.filter("NOT _stays").select("_gone_key"), "near-gone")
    same = F.col(key).eqNullSafe(F.col("_gone_key"))
    # by sort-merge at every size: what is dropped grows with the table and is nothing to broadcast
    return df.join(gone.hint("merge"), same, "left_anti")


def keep_one_of_each_group(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Exactly one row of each group of near copies: the smallest key, then the smallest row number.

    Rows are decided one by one, whatever their keys: NULL keys lose to others, and rows that repeat
    a key stay or go by their own text. The rows are written once with their number.
    """
    numbered, row = with_row_number(df, "near-rows")
    prints = numbered.select(
        F.col(row).alias("_row"), F.col(key).alias("_key"), simhash_column(F.col(text)).alias("fp")
    )
    prints = materialize(prints, "prints")
    first = F.min(F.struct(F.col("_key").isNull().alias("_none"), "_key", "_row"))
    nodes = materialize(prints.groupBy("fp").agg(first.alias("min_id")), "print-nodes")
    found = component_minimum(nodes.withColumnRenamed("fp", "node"), near_links(nodes.select("fp")))
    stays = found.select(F.col("component_id._row").alias("_stays")).distinct()
    stays = materialize(stays, "near-stays")
    # by sort-merge at every size: what stays grows with the table and is nothing to broadcast
    kept = numbered.join(stays.hint("merge"), F.col(row) == F.col("_stays"), "left_semi")
    return kept.drop(row)
