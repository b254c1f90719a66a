"""Exact top-k search by inner product over vector-approximation files.

Every file holds the vectors of one length: first their cells, 2**bits equal steps between the least
and the greatest value of each component in the file, a byte each; behind them the exact vectors. A
search scans the cells of a slab, which bound every product from both sides: the bounds differ from the
product with the cells' lower edges by a constant per query, so they are one matrix product. The exact
vectors of the candidates left are then read in the order of their bounds, until no bound that is left
reaches the kth product found.

File layout, little-endian (fixed values of the format):
  "VAFILE01", u64 vectors, u64 components, u64 bytes of an exact component
  i64 key of each vector, u8 whether it has a key, i64 row number of each vector
  i64 least value of each component, i64 step of each component
  u8 cells, vector by vector; exact components, vector by vector
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rolloom.llm.row_numbers import with_row_number
from rolloom.llm.shared_files import MANIFEST, commit, locate, open_new, open_old, temporary_name
from rolloom.session import materialize, scratch_path

MAGIC = b"VAFILE01"
HEAD = "<8sQQQ"
K = 5
QUERY_STEP = 50
SCALE = 256
BITS = 6  # of a cell
FILE_COMPONENTS = 1 << 22
QUERY_COMPONENTS = 1 << 16  # of the queries that go through a file together
SLAB_ROWS = 4096
_GAP = 1 << 16  # bytes that are read rather than skipped
_LONG = 1 << 62  # bounds differ by less than this, so nothing overflows


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scaled vectors as bytes of i64; NULL where a vector takes no part."""
    for batch in batches:
        raws: list[bytes | None] = []
        for values in batch.column(1):
            raw = None
            if values.is_valid and len(values) and values.values.null_count == 0:
                wide = np.floor(
                    np.asarray(values.values.to_numpy(zero_copy_only=False), np.float64) * SCALE
                )
                if np.isfinite(wide).all():
                    if np.abs(wide).max() >= 2.0**62:
                        raise OverflowError("a scaled component does not fit into a long")
                    raw = wide.astype("<i8").tobytes()
            raws.append(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raws, pa.binary())], ["id", "x"])


def _largest(*parts: np.ndarray) -> int:
    return max((max(-int(x.min()), int(x.max())) for x in parts if x.size), default=0)


def _kind(bound: int) -> type:
    """The fastest type that holds sums up to ``bound`` exactly."""
    if bound < 1 << 24:
        return np.float32
    if bound < 1 << 53:
        return np.float64
    if bound < _LONG:
        return np.int64
    raise OverflowError("a score may not fit into a long")


def cells_of(vectors: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least values and steps of the components, and the cells of the vectors."""
    low, high = vectors.min(axis=0), vectors.max(axis=0)
    step = (high - low) // (1 << bits) + 1
    return low, step, ((vectors - low) // step).astype(np.uint8)


def write_file(uri: str, keys: list[int | None], rows: list[int], vectors: np.ndarray, bits: int) -> int:
    low, step, cells = cells_of(vectors, bits)
    most = _largest(vectors)
    size = 2 if most < 1 << 15 else 4 if most < 1 << 31 else 8
    out = open_new(uri)
    out.write(struct.pack(HEAD, MAGIC, *vectors.shape, size))
    out.write(np.array([k or 0 for k in keys], "<i8").tobytes())
    out.write(np.array([k is not None for k in keys], "u1").tobytes())
    out.write(np.array(rows, "<i8").tobytes())
    out.write(low.astype("<i8").tobytes() + step.astype("<i8").tobytes())
    out.write(cells.tobytes())
    out.write(vectors.astype(f"<i{size}").tobytes())
    out.close()
    return len(vectors)


class ApproximationFile:
    """Keys and marks of a file; cells and exact vectors are read when asked for."""

    def __init__(self, uri: str):
        self._file = open_old(uri)
        head = self._file.read(struct.calcsize(HEAD))
        magic, self.count, self.length, self._size = struct.unpack(HEAD, head)
        if magic != MAGIC:
            raise ValueError(f"{uri} is no finished file")
        n, d = self.count, self.length
        self.keys = np.frombuffer(self._file.read(8 * n), "<i8")
        self.missing = np.frombuffer(self._file.read(n), "u1") == 0
        self.rows = np.frombuffer(self._file.read(8 * n), "<i8")
        self.low = np.frombuffer(self._file.read(8 * d), "<i8")
        self.step = np.frombuffer(self._file.read(8 * d), "<i8")
        self._cells_at = struct.calcsize(HEAD) + 17 * n + 16 * d
        self._exact_at = self._cells_at + n * d
        self.exact_read = 0  # vectors

    def cells(self, begin: int, end: int) -> np.ndarray:
        self._file.seek(self._cells_at + begin * self.length)
        raw = self._file.read((end - begin) * self.length)
        return np.frombuffer(raw, np.uint8).reshape(-1, self.length)

    def exact(self, places: np.ndarray) -> np.ndarray:
        """Vectors at ascending places; places close to each other are read in one go."""
        width = self.length * self._size
        out = np.empty((len(places), self.length), np.int64)
        cuts = np.flatnonzero(np.diff(places) * width > _GAP) + 1
        for part in np.split(np.arange(len(places)), cuts):
            first, last = int(places[part[0]]), int(places[part[-1]])
            self._file.seek(self._exact_at + first * width)
            raw = np.frombuffer(self._file.read((last + 1 - first) * width), f"<i{self._size}")
            out[part] = raw.reshape(-1, self.length)[places[part] - first]
        self.exact_read += len(places)
        return out

    def close(self) -> None:
        self._file.close()


class Best:
    """The k best candidates of each query: by score, then key (missing ones last), then row."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.kth = np.full(queries, -_LONG, np.int64)
        self.columns = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]

    def add(self, *new: np.ndarray) -> None:
        """``new``: query, score, whether the key is missing, key, row number."""
        columns = [np.concatenate(pair) for pair in zip(self.columns, new)]
        query, score, missing, key, row = columns
        order = np.lexsort((row, key, missing, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        stays = rank < self.k
        self.columns = [c[order][stays] for c in columns]
        last = rank[stays] == self.k - 1
        self.kth[self.columns[0][last]] = self.columns[1][last]


def search_file(file: ApproximationFile, queries: np.ndarray, best: Best) -> None:
    """Brings ``best`` up to date with the vectors of a file."""
    if not len(queries):
        return
    scaled = queries * file.step
    base = queries @ file.low
    gain = (np.maximum(queries, 0) * (file.step - 1)).sum(axis=1)
    loss = (np.minimum(queries, 0) * (file.step - 1)).sum(axis=1)
    d = file.length
    _kind(d * (_largest(queries) * (_largest(file.low) + 256 * _largest(file.step))))
    kind = _kind(d * _largest(scaled) * 255)
    scaled = scaled.astype(kind)
    for begin in range(0, file.count, SLAB_ROWS):
        end = min(begin + SLAB_ROWS, file.count)
        edges = (scaled @ file.cells(begin, end).T.astype(kind)).astype(np.int64)
        edges += base[:, None]
        need = best.kth - gain  # on the scale of the lower edges
        if end - begin >= best.k:
            there = np.partition(edges, end - begin - best.k, axis=1)[:, end - begin - best.k]
            need = np.maximum(need, there + loss - gain)
        query, place = np.nonzero(edges >= need[:, None])
        bound = edges[query, place] + gain[query]
        order = np.lexsort((place, -bound, query))
        query, place, bound = query[order], place[order], bound[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        slot = np.full(end - begin, -1)  # where a vector that has been read lies in ``read``
        read = np.zeros((0, d), np.int64)
        done, most = 0, best.k
        while len(query):
            # the next few of each query, more each time, as long as their bounds reach its kth
            now = rank < done + most
            q, p = query[now], place[now]
            fresh = np.unique(p[slot[p] < 0])
            if len(fresh):
                slot[fresh] = len(read) + np.arange(len(fresh))
                read = np.concatenate([read, file.exact(begin + fresh)])
            for at in range(0, len(q), 1 << 16):
                i, j = q[at : at + (1 << 16)], p[at : at + (1 << 16)]
                score = np.einsum("ij,ij->i", queries[i], read[slot[j]])
                j = begin + j
                best.add(i, score, file.missing[j], file.keys[j], file.rows[j])
            done, most = done + most, most * 2
            left = ~now & (bound >= best.kth[query])
            query, place, bound, rank = (x[left] for x in (query, place, bound, rank))


_FILES = pa.schema(
    [
        ("name", pa.string()),
        ("temporary", pa.string()),
        ("length", pa.int64()),
        ("n_vectors", pa.int64()),
    ]
)


def _runs(batches: Iterator[pa.RecordBatch], components: int) -> Iterator[tuple[list, list, np.ndarray]]:
    """(keys, rows, vectors) of as many vectors of one length as ``components`` allow; the input comes
    sorted by length."""
    keys: list[int | None] = []
    rows: list[int] = []
    raws: list[bytes] = []
    for batch in batches:
        for key, row, raw in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if raws and (
                len(raw) != len(raws[0]) or (len(raws) + 1) * len(raw) > 8 * components
            ):
                yield keys, rows, np.frombuffer(b"".join(raws), "<i8").reshape(len(raws), -1)
                keys, rows, raws = [], [], []
            keys.append(key)
            rows.append(row)
            raws.append(raw)
    if raws:
        yield keys, rows, np.frombuffer(b"".join(raws), "<i8").reshape(len(raws), -1)


def _file_writer(folder: str, bits: int) -> Callable:
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        made = []
        for keys, rows, vectors in _runs(batches, FILE_COMPONENTS):
            name = f"vectors-{part:06d}-{len(made):06d}.va"
            temporary = temporary_name(folder, name)
            n = write_file(temporary, keys, rows, vectors, bits)
            made.append(
                {"name": name, "temporary": temporary, "length": vectors.shape[1], "n_vectors": n}
            )
        yield pa.RecordBatch.from_pylist(made, schema=_FILES)

    return write


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for keys, rows, vectors in _runs(batches, QUERY_COMPONENTS):
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([vectors.shape[1]], pa.int64()),
                pa.array([keys], pa.list_(pa.int64())),
                pa.array([rows], pa.list_(pa.int64())),
                pa.array([vectors.astype("<i8").tobytes()], pa.binary()),
            ],
            ["length", "keys", "rows", "vectors"],
        )


def _searcher(folder: str, runs: int, k: int) -> Callable:
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = locate(f"{folder}/{MANIFEST}")
        listed = pq.read_table(path, filesystem=store, columns=["name", "length"]).sort_by("name")
        files: dict[int, list[str]] = {}
        for name, length in zip(*(listed.column(c).to_pylist() for c in ("name", "length"))):
            files.setdefault(length, []).append(name)
        for batch in batches:
            for unit in batch.to_pylist():
                length = unit["length"]
                queries = np.frombuffer(unit["vectors"], "<i8").reshape(-1, length).astype(np.int64)
                best = Best(len(queries), k)
                for name in files.get(length, [])[unit["run"] :: runs]:
                    file = ApproximationFile(f"{folder}/{name}")
                    search_file(file, queries, best)
                    file.close()
                query, score, missing, key, row = best.columns
                keys, rows = (pa.array(unit[c], pa.int64()).take(pa.array(query)) for c in ("keys", "rows"))
                yield pa.RecordBatch.from_arrays(
                    [keys, rows, pa.array(key, mask=missing), pa.array(row), pa.array(score)],
                    ["query_id", "query_row", "vec_id", "row", "score"],
                )

    return search


def top_k(
    df: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = K,
    query_step: int = QUERY_STEP,
    bits: int = BITS,
) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the k highest integer inner products of each query.

    Components are ``floor(256 * x)``. Queries are the rows whose key is divisible by ``query_step``;
    candidates are all rows of the same length but the query's own. Ties go to the smaller key, NULL
    keys come last among them. Rows with equal vectors are folded to the k + 1 smallest keys, of which
    a query can need no more. Queries go through the files in blocks; the work is queries x rows, and
    a block gives k + 1 candidates per query, never its pairs.

    Vectors that are NULL, empty or hold NULL, NaN or infinite components take no part, as query or as
    candidate. Rows that repeat a key are rows of their own. A query without candidates has no rows. A
    score that could exceed 64 bits is an error. Other columns of the input are not looked at.
    """
    spark = df.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    rows = rows.mapInArrow(_prepare, "id bigint, x binary").filter("x IS NOT NULL")
    rows, row = with_row_number(rows, "vectors")
    rows = rows.select("id", F.col(row).alias("row"), "x", F.octet_length("x").alias("size"))

    # row_number with a limit is cut on the map side, so a vector that most rows share stays few rows
    copies = Window.partitionBy("x").orderBy(F.col("id").asc_nulls_last(), "row")
    few = rows.withColumn("_copy", F.row_number().over(copies)).filter(F.col("_copy") <= k + 1)
    folder = scratch_path(spark, "vector-approximations")
    files = few.sortWithinPartitions("size", "row").select("id", "row", "x")
    files = files.mapInArrow(
        _file_writer(folder, bits), "name string, temporary string, length bigint, n_vectors bigint"
    )
    n_files = commit(spark, files, folder).count()

    asked = rows.filter(F.col("id") % query_step == 0).sortWithinPartitions("size", "row")
    blocks = asked.select("id", "row", "x").mapInArrow(
        _pack, "length bigint, keys array<bigint>, rows array<bigint>, vectors binary"
    )
    blocks = materialize(blocks, "query-blocks")
    # few blocks search their files in several runs, so that all cores take part
    runs = max(1, min(n_files, -(-4 * tasks // max(1, blocks.count()))))
    units = blocks.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))
    found = units.repartition(4 * tasks).mapInArrow(
        _searcher(folder, runs, k + 1),
        "query_id bigint, query_row bigint, vec_id bigint, row bigint, score bigint",
    )
    best = Window.partitionBy("query_row").orderBy(
        F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row"
    )
    ranked = found.filter("row <> query_row").withColumn("rank", F.row_number().over(best))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
