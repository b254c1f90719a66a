"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

A unit vector x is quantised to s * q with q in int8, leaving an error of known length e. For two of
them |x.y - s_x s_y q_x.q_y| <= e_x |s_y q_y| + |x| e_y, so a tile of products tells for nearly all
pairs on which side of the threshold they lie; only pairs within the bound are computed again in
double precision. All pairs of blocks are compared, which costs the square of the number of
different vectors; a tile gives counts and a spanning forest of its links, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rolloom.llm.components import component_minimum
from rolloom.session import materialize

THRESHOLD = 0.95
BLOCK_ROWS = 4096  # vectors of a block; a tile holds two blocks
_SLAB = 512  # rows of a tile multiplied at once
_SLACK = 1e-6  # above the rounding of the bounds themselves


def _prepare(dtype: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[bytes | None] = []
            raws: list[bytes | None] = []
            for values in batch.column(1):
                key = raw = None
                if values.is_valid and len(values) and values.values.null_count == 0:
                    vector = np.asarray(values.values.to_numpy(zero_copy_only=False), dtype)
                    wide = vector.astype(np.float64)
                    if np.isfinite(wide).all() and wide.any():
                        raw = (vector + vector.dtype.type(0)).tobytes()  # -0.0 becomes 0.0
                        key = hashlib.blake2b(raw, digest_size=16).digest()
                keys.append(key)
                raws.append(raw)
            columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(raws, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["vec", "key", "raw"])

    return prepare


def _unit(raws: list[bytes], dtype: str) -> np.ndarray:
    wide = np.stack([np.frombuffer(x, dtype) for x in raws]).astype(np.float64)
    wide /= np.abs(wide).max(axis=1, keepdims=True)  # lengths neither overflow nor vanish
    return wide / np.sqrt((wide * wide).sum(axis=1, keepdims=True))


def _quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scale, length of the error, length of the quantised vector."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    rough = codes * scale[:, None]
    error = np.sqrt(((unit - rough) ** 2).sum(axis=1))
    return codes, scale, error, np.sqrt((rough**2).sum(axis=1))


def tile_links(
    left: np.ndarray, right: np.ndarray, same: bool, threshold: float
) -> Iterator[tuple[int, np.ndarray]]:
    """For slabs of ``left``: their first row, and which rows of ``right`` each links with.

    ``same``: both sides are one block; then only pairs above the diagonal are looked at.
    """
    q1, s1, e1, _ = _quantise(left)
    q2, s2, e2, n2 = _quantise(right)
    # sums of products of int8 are exact in float32 up to 2**24
    kind = np.float32 if left.shape[1] * 127 * 127 < 1 << 24 else np.float64
    codes = q2.T.astype(kind)
    for at in range(0, len(left), _SLAB):
        to = min(at + _SLAB, len(left))
        rough = (q1[at:to].astype(kind) @ codes).astype(np.float64)
        rough *= s1[at:to, None]
        rough *= s2[None, :]
        bound = e1[at:to, None] * n2[None, :] + (e2[None, :] + _SLACK)
        links = rough - bound >= threshold
        near = (rough + bound >= threshold) & ~links
        if same:
            above = np.arange(len(right))[None, :] > np.arange(at, to)[:, None]
            links &= above
            near &= above
        i, j = np.nonzero(near)
        for part in range(0, len(i), 1 << 14):
            a, b = i[part : part + (1 << 14)], j[part : part + (1 << 14)]
            exact = np.einsum("ij,ij->i", left[at + a], right[b])
            links[a, b] = exact >= threshold
        yield at, links


def _tile(dtype: str, threshold: float) -> Callable[[tuple, pa.Table], pa.Table]:
    def tile(key: tuple, table: pa.Table) -> pa.Table:
        nodes, copies, block, raws = (
            table.column(n).combine_chunks() for n in ("node", "copies", "block", "raw")
        )
        nodes, copies, block = (x.to_numpy(zero_copy_only=False) for x in (nodes, copies, block))
        order = np.lexsort((nodes, block))
        nodes, copies, block = nodes[order], copies[order], block[order]
        unit = _unit(raws.take(pa.array(order)).to_pylist(), dtype)
        low, high = key[1].as_py(), key[2].as_py()
        same = low == high
        cut = len(nodes) if same else int(np.searchsorted(block, high))
        lefts, offset = slice(0, cut), 0 if same else cut
        rights = slice(offset, len(nodes))
        n_links = np.zeros(len(nodes), np.int64)
        label = np.arange(len(nodes))  # of the component inside the tile: its first row
        if cut and offset < len(nodes):
            weights = copies.astype(np.float64)
            for at, links in tile_links(unit[lefts], unit[rights], same, threshold):
                rows = slice(at, at + len(links))
                n_links[rows] += (links @ weights[rights]).astype(np.int64)
                n_links[rights] += (weights[rows] @ links).astype(np.int64)
                for i in np.flatnonzero(links.any(axis=1)):
                    met = np.append(offset + np.flatnonzero(links[i]), at + i)
                    found = np.unique(label[met])
                    if len(found) > 1:
                        label[np.isin(label, found)] = found[0]
        hit = np.flatnonzero((n_links > 0) | (label != np.arange(len(nodes))))
        return pa.table(
            {
                "node": pa.array(nodes[hit]),
                "links": pa.array(n_links[hit]),
                "other": pa.array(nodes[label[hit]]),
            }
        )

    return tile


def embedding_groups(
    df: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD
) -> DataFrame:
    """``(key, n_links, component_id, kept)`` per row.

    ``n_links`` counts the other rows with cosine >= threshold, ``component_id`` is the smallest key
    reachable by links, ``kept`` whether that is the row's own key.

    Exact copies are linked without being compared and counted with their number. Vectors that are
    NULL, empty, zero or hold NULL, NaN or infinite components link with nothing; vectors of different
    lengths do not link. NULL keys never win a group. Rows that repeat a key count as separate rows.
    No rows give no rows. Other columns of the input are not looked at.
    """
    spark = df.sparkSession
    element = df.schema[vector].dataType.elementType
    narrow = isinstance(element, T.FloatType)
    dtype, cast = ("<f4", "array<float>") if narrow else ("<f8", "array<double>")
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("vec"), F.col(vector).cast(cast).alias("x"))
    rows = rows.mapInArrow(_prepare(dtype), f"vec {key_type}, key binary, raw binary")
    rows = materialize(rows, "vectors")

    groups = rows.filter("key IS NOT NULL").groupBy("key")
    nodes = groups.agg(
        F.count(F.lit(1)).alias("copies"), F.min("vec").alias("min_id"), F.first("raw").alias("raw")
    ).withColumn("node", F.monotonically_increasing_id())
    nodes = materialize(nodes, "vector-nodes")  # written, so that the numbers stay

    per_length = nodes.groupBy(F.octet_length("raw").alias("size")).agg(
        F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks")
    )
    per_length = materialize(per_length, "vector-blocks")  # one row per vector length
    sized = nodes.withColumn("size", F.octet_length("raw")).join(per_length, "size")
    sized = sized.withColumn("block", F.expr("int(pmod(xxhash64(node), blocks))"))
    tiles = sized.selectExpr(
        "size", "node", "copies", "block", "raw", "explode(sequence(0, blocks - 1)) AS k"
    ).selectExpr(
        "size", "least(k, block) AS low", "greatest(k, block) AS high",
        "node", "copies", "block", "raw",
    )
    found = tiles.groupBy("size", "low", "high").applyInArrow(
        _tile(dtype, threshold), "node bigint, links bigint, other bigint"
    )
    found = materialize(found, "vector-links")

    degree = found.groupBy("node").agg(F.sum("links").alias("links"))
    links = found.filter("node <> other").selectExpr("node AS a", "other AS b")
    group = component_minimum(nodes.select("node", "min_id"), links)
    known = nodes.select("node", "key", "copies").join(group, "node").join(degree, "node", "left")
    known = known.select(
        "key",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        "component_id",
    )
    valid = rows.filter("key IS NOT NULL").select("vec", "key").join(known, "key")
    apart = rows.filter("key IS NULL").select(
        "vec", F.lit(0).cast("bigint").alias("n_links"), F.col("vec").alias("component_id")
    )
    out = valid.select("vec", "n_links", "component_id").unionByName(apart)
    return out.select(
        F.col("vec").alias(key),
        "n_links",
        "component_id",
        F.col("vec").eqNullSafe(F.col("component_id")).alias("kept"),
    )
