"""Merkle manifests, importance resampling and exact search against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rolloom.llm import resampling, topk_search
from rolloom.llm.merkle import merkle_manifest, without_line_feeds
from rolloom.llm.resampling import feature_chunks, resample
from rolloom.llm.row_numbers import with_positions
from rolloom.llm.topk_search import ApproximationFile, Best, search_file, top_k, write_file

DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string"


# --- places ----------------------------------------------------------------------------------------


def test_positions(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["b", "b", "b", "a", None]), rng.randrange(50), i) for i in range(700)]
    got = with_positions(
        spark.createDataFrame(rows, "g string, k int, i int"), ["k", "i"], ["g"]
    ).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2]))
    sizes = Counter(r[0] for r in rows)
    start = {}
    for place, r in enumerate(order):
        start.setdefault(r[0], place)
    want = {r[2]: (place - start[r[0]], sizes[r[0]], start[r[0]]) for place, r in enumerate(order)}
    assert {r["i"]: (r["_at"], r["_n"], r["_start"]) for r in got} == want


# --- Merkle ----------------------------------------------------------------------------------------


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def brute_leaf(row):
    return sha("".join(
        "-" if v is None else f"{len(str(v).encode())}:{v}" for v in row
    ))


def climb(nodes, arity):
    """The root, and per node its siblings on each level as (left, right)."""
    steps = [[] for _ in nodes]
    place = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(place):
            run = at - at % arity
            steps[i].append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + arity])))
            place[i] = at // arity
        nodes = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)]
    return nodes[0], steps


def brute_merkle(rows, presented, arity=3):
    groups: dict = {}
    for row, shown in zip(rows, presented):
        groups.setdefault(row[1], []).append((row, shown))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subroots, below = [], []
    for name in names:
        members = sorted(
            groups[name],
            key=lambda m: (m[0][0] is not None, m[0][0] or 0, brute_leaf(m[0])),
        )
        root, steps = climb([brute_leaf(m[0]) for m in members], arity)
        subroots.append(root)
        below.append((members, steps))
    root, above = climb(subroots, arity)
    out = []
    for subroot, top, (members, steps) in zip(subroots, above, below):
        for (row, shown), mine in zip(members, steps):
            path = mine + top
            node = brute_leaf(shown)
            for left, right in path:
                node = sha(left + node + right)
            proof = sha("".join(left + right for left, right in path))
            out.append((row[0], brute_leaf(row), subroot, root, proof, node, node == root))
    return sorted(out, key=repr)


def tampered(row):
    key, *rest, text = row
    if key is not None and text is not None and zlib.crc32(str(key).encode()) % 2 == 0:
        text = text.replace("\n", "")
    return (key, *rest, text)


def merkle_rows(spark, rows):
    got = merkle_manifest(spark.createDataFrame(rows, DOCS), presented=without_line_feeds())
    return sorted((tuple(r) for r in got.drop("steps").collect()), key=repr)


def test_merkle_trees_of_all_sizes(spark):
    rows = []
    for n in (1, 2, 3, 4, 9, 10, 28, 82):  # around the powers of three
        rows += [(1000 * n + i, f"s{n}", "en", i, f"text\n{i}") for i in range(n)]
    assert merkle_rows(spark, rows) == brute_merkle(rows, list(map(tampered, rows)))


def test_merkle_hard_rows(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, None), (2, None, "en", 3, "a\nb"),
        (2, "s", "en", 3, "a\nb"), (2, "s", "en", 3, "a\nb"), (2, "s", "en", 3, "b"),
        (-5, "s", "", 0, ""), (7, "é", "fr", 1, "é" * 100_000 + "\n"), (7, "z", None, 1, "\n\n"),
        (8, "", "en", 2, None), (9, "\U0001f600", "en", 2, "x"), (10, "￿", "en", 2, "x"),
    ]
    assert merkle_rows(spark, rows) == brute_merkle(rows, list(map(tampered, rows)))


def test_merkle_binary_and_wide_trees_and_clashing_columns(spark):
    rows = [(i, "ab"[i % 5 == 0], "en", i, f"t{i}") for i in range(37)]
    frame = spark.createDataFrame(rows, DOCS)
    for name in ("tree", "at", "n", "digest", "_row", "steps", "left", "key", "group"):
        frame = frame.withColumn(name, F.lit("x"))
    for arity in (2, 5):
        got = merkle_manifest(frame, arity=arity).drop("steps").collect()
        assert sorted(map(tuple, got), key=repr) == brute_merkle(rows, rows, arity)


def test_merkle_without_rows_and_with_one(spark):
    assert merkle_rows(spark, []) == []
    (one,) = merkle_rows(spark, [(3, "s", "en", 1, "x")])
    assert one[1] == one[2] == one[3] == one[5] and one[4] == sha("") and one[6]


def test_a_changed_or_missing_row_changes_the_root(spark):
    rows = [(i, f"s{i % 3}", "en", i, f"t{i}") for i in range(20)]
    root = merkle_rows(spark, rows)[0][3]
    assert merkle_rows(spark, rows[:-1])[0][3] != root
    assert merkle_rows(spark, [*rows[:-1], (19, "s1", "en", 19, "T19")])[0][3] != root
    assert merkle_rows(spark, rows[::-1])[0][3] == root


# --- resampling -------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_features(text, longest=2):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(lowered)
    runs = [
        " ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)
    ]
    return words, runs


def brute_resample(rows, target, percent=25, least=20, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in brute_features(text)[1])
    t = Counter(bucket(f) for text in target for f in brute_features(text)[1])
    every, wanted = sum(s.values()), sum(t.values())

    def gain(b):
        ratio = ((t[b] + 1) * (every + buckets)) / ((s[b] + 1) * (wanted + buckets))
        return math.floor(1000 * math.log(ratio))

    out = []
    for key, text in rows:
        words, runs = brute_features(text)
        weight = sum(gain(bucket(f)) for f in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"7:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        noise = math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(words), len(runs), weight, weight + noise, None])
    able = [r for r in out if r[1] >= least]
    able.sort(key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[5] = rank
    return sorted(map(tuple, out), key=repr)


def random_texts(n, seed=1):
    rng = random.Random(seed)
    pool = [f"w{i}" for i in range(300)] + ["Ünï", "ÀB", "x-y", "a b", "9", "日本語"]
    return [
        rng.choice([" ", "\n", ", ", "\x00"]).join(rng.choices(pool, k=rng.randrange(90)))
        for _ in range(n)
    ]


def test_resample_equals_brute_force(spark):
    texts = random_texts(300)
    rows = [*enumerate(texts), (300, None), (301, ""), (302, "?!"), (303, "A" * 100_000),
            (304, texts[5]), (-7, texts[5]), (None, texts[6] * 2)]
    target = [*random_texts(20, seed=2), None, ""]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("_at", F.lit(1))
    frame = frame.withColumn("score", F.lit("x")).repartition(5)
    got = resample(frame, spark.createDataFrame([(x,) for x in target], "text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_resample(rows, target)


def test_repeated_keys_are_ranked_once_each(spark):
    text = " ".join(f"w{i}" for i in range(30))
    frame = spark.createDataFrame([(1, text)] * 10 + [(None, text)] * 10, "doc_id bigint, text string")
    got = resample(frame, frame, percent=50)
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == list(range(1, 11))


def test_resample_empty_tables(spark):
    nothing = spark.createDataFrame([], "doc_id bigint, text string")
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id bigint, text string")
    assert resample(nothing, some).count() == 0
    assert resample(some, nothing, percent=100).collect()[0]["rank"] == 1


@pytest.mark.parametrize("chunk", [1, 7, 50])
@pytest.mark.parametrize("longest", [1, 2, 4])
def test_chunks_lose_no_feature(monkeypatch, chunk, longest):
    monkeypatch.setattr(resampling, "_CHUNK", chunk)
    for text in random_texts(20, seed=4):
        words, runs = brute_features(text, longest)
        found = list(feature_chunks(text.encode(), 1 << 31, longest))
        assert sum(n for n, _ in found) == len(words)
        want = Counter(zlib.crc32(f.encode()) % (1 << 31) for f in runs)
        assert Counter(x for _, ids in found for x in ids.tolist()) == want


# --- search -----------------------------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<double>"


def brute_top(rows, k=5, step=50):
    usable = [
        (i, key, [math.floor(256 * x) for x in v])
        for i, (key, v) in enumerate(rows)
        if v and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, key, q in usable:
        if key is None or key % step:
            continue
        found = sorted(
            (-sum(a * b for a, b in zip(q, v)), other is None, other or 0, j)
            for j, other, v in usable
            if j != i and len(v) == len(q)
        )
        out += [
            (key, rank, None if missing else other, -score)
            for rank, (score, missing, other, _) in enumerate(found[:k], 1)
        ]
    return sorted(out, key=repr)


def search(frame, **more):
    return sorted(map(tuple, top_k(frame, **more).collect()), key=repr)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 16))
    rows = [
        (int(i), [float(x) for x in centres[i % 6] * 0.2 + rng.normal(size=16) * 0.05])
        for i in range(800)
    ]
    rows += [(int(800 + i), rows[7][1]) for i in range(150)]  # copies, queries among them
    rows += [(-50, rows[3][1]), (None, rows[3][1]), (None, rows[50][1]), (50, rows[100][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(1000, None), (1050, []), (1100, [nan] * 16), (1150, [inf] + [0.0] * 15),
             (1200, [None] + [0.0] * 15), (1250, [0.0] * 16), (1300, [1.0, 2.0]), (1301, [2.0, 1.0]),
             (1350, [0.5] * 3)]
    frame = spark.createDataFrame(rows, VECTORS).withColumn("row", F.lit("x")).repartition(4)
    assert search(frame) == brute_top(rows)
    assert search(frame, k=2, query_step=7, bits=2) == brute_top(rows, 2, 7)


def test_top_k_of_nothing_and_of_one(spark):
    assert search(spark.createDataFrame([], VECTORS)) == []
    assert search(spark.createDataFrame([(0, [1.0])], VECTORS)) == []


def test_large_components_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, [rng.uniform(-1e6, 1e6) for _ in range(4)]) for i in range(120)]
    assert search(spark.createDataFrame(rows, VECTORS)) == brute_top(rows)
    with pytest.raises(Exception, match="fit into a long"):
        search(spark.createDataFrame([(0, [1e30]), (1, [1e30])], VECTORS))


def test_few_exact_vectors_are_read(tmp_path):
    """Cells bound the products: the exact vectors of most candidates are never read."""
    rng = np.random.default_rng(6)
    vectors = rng.integers(-100, 100, size=(20_000, 32))
    path = str(tmp_path / "v.va")
    write_file(f"file://{path}", list(range(20_000)), list(range(20_000)), vectors, bits=6)
    file = ApproximationFile(f"file://{path}")
    best = Best(3, 5)
    search_file(file, vectors[:3].astype(np.int64), best)
    assert file.exact_read < 1000
    query, score, _, key, _ = best.columns
    for q in range(3):
        want = np.sort(vectors @ vectors[q])[::-1][:5]
        assert score[query == q].tolist() == want.tolist()
        assert (vectors[key[query == q]] @ vectors[q]).tolist() == want.tolist()
    file.close()


def test_slabs_and_files_split_anywhere(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(9)
    vectors = rng.integers(-9, 9, size=(300, 5))  # many ties
    monkeypatch.setattr(topk_search, "SLAB_ROWS", 7)
    best = Best(300, 4)
    for n, part in enumerate(np.array_split(np.arange(300), 11)):
        uri = f"file://{tmp_path}/{n}.va"
        write_file(uri, part.tolist(), part.tolist(), vectors[part], bits=2)
        file = ApproximationFile(uri)
        search_file(file, vectors.astype(np.int64), best)
        file.close()
    products = vectors @ vectors.T
    for q in range(300):
        order = np.lexsort((np.arange(300), -products[q]))[:4]
        assert best.columns[3][best.columns[0] == q].tolist() == order.tolist()
