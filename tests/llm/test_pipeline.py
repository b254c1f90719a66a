"""The corpus pipeline against a plain walk through its stages, and the registered queries."""

from __future__ import annotations

import re
import zlib
from pathlib import Path

import __spark_entry__ as registry
import corpus_pipeline
import duckdb
import numpy as np
import pytest
import sentencepiece
from compare import canonical, sql_connection
from conftest import SF_CHECK, SF_SMALL
from pyspark.sql import functions as F

from rolloom.llm.language_id import UNDETERMINED, LanguageModel, held_out, language_samples, tag_language
from rolloom.llm.oracle import MIX, OP6, ORACLE
from rolloom.llm.queries import PIECE_MODEL, QUERIES
from rolloom.llm.simhash import simhash

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def walk(rows):
    """Stages one to four on a list of (doc_id, text, lang, source, n_chars)."""
    rows = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    best: dict = {}
    for r in rows:
        body = re.sub(r"[\x20\x09-\x0D]", "", r[1])
        if body not in best or (-len(r[1]), r[0]) < (-len(best[body][1]), best[body][0]):
            best[body] = r
    rows = sorted(best.values())
    prints = [simhash(r[1]) % (1 << 64) for r in rows]
    groups = list(range(len(rows)))

    def find(x):
        while groups[x] != x:
            x = groups[x]
        return x

    values = np.array(prints, np.uint64)
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values[i + 1 :]) <= 3):
            a, b = sorted((find(i), find(i + 1 + int(j))))
            groups[b] = a
    rows = [r for i, r in enumerate(rows) if find(i) == i]
    connection = duckdb.connect()
    connection.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    connection.executemany("INSERT INTO docs VALUES (?, ?, ?)", [(r[0], r[1], r[3]) for r in rows])
    epochs = dict(
        connection.sql(MIX.format(documents="docs") + "SELECT doc_id, epochs FROM mixed").fetchall()
    )
    return [r for r in rows for _ in range(epochs[r[0]])]


def test_run_against_the_walk(spark, tmp_path):
    documents = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [tuple(r) for r in documents.select("doc_id", "text", "lang", "source", "n_chars").collect()]
    # no label where none is learned from: the language in the result is the one identified
    rows = [(*r[:2], None if zlib.crc32(str(r[0]).encode()) % 3 == 1 else r[2], *r[3:]) for r in rows]
    rows += [
        (900_001, None, "en", "src1", 0), (900_002, "12 !", "en", None, 4), (900_003, "", None, "src1", 0),
        (900_004, "the words of one source alone", "en", None, 29), (900_005, "word " * 30_000, "en", "src2", 0),
    ]
    spark.createDataFrame(rows, DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    labelled = spark.read.parquet(f"{tmp_path}/documents.parquet").filter(~held_out())
    model = LanguageModel(language_samples(labelled))
    want = [(r[0], r[3] or "", model.predict([r[1]])[0][0], library.encode(r[1])) for r in walk(rows)]
    assert sorted((r["doc_id"], r["source"] or "", r["lang"], r["ids"]) for r in found) == sorted(want)
    assert not {r["lang"] for r in found} & {UNDETERMINED, None}
    assert any(labels is None for key, _, labels, *_ in rows if key in {r["doc_id"] for r in found})
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)


def test_stages_keep_the_columns(spark):
    frame = spark.createDataFrame(
        [(1, "some words here", "en", "a", 3, "x"), (2, None, None, None, None, None)],
        DOCUMENTS + ", _whole string",
    )
    for _, stage in corpus_pipeline.STAGES[:-1]:
        for docs in (frame, frame.limit(0)):
            kept = stage(spark, docs, SF_SMALL)
            assert kept.columns == frame.columns
            assert [f.dataType for f in kept.schema] == [f.dataType for f in frame.schema]
    assert tag_language(frame).count() == 1
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_with_sql(spark, name):
    columns, _, want = canonical(sql_connection(SF_CHECK).sql(ORACLE[name]).df())
    found = canonical(QUERIES[name](spark, SF_CHECK).toPandas())
    assert found[0] == columns and found[2] == want and want


def test_embedding_links_with_sql(spark):
    want = dict(sql_connection(SF_SMALL).sql(OP6).fetchall())
    found = QUERIES["op6_embedding_dedup"](spark, SF_SMALL)
    assert {r["vec_id"]: r["n_links"] for r in found.collect()} == want


def test_every_operator_is_registered_and_whole(spark):
    names = registry.queries()
    assert "pipeline" in names
    for number in range(1, 14):
        assert sum(n.startswith(f"op{number}_") for n in names) == 1
    tables = {"op3_warc": "pages", "op5_html_text": "pages", "op6_embedding_dedup": "embeddings"}
    for name, query in QUERIES.items():
        if name == "op13_topk_search":
            continue  # five rows per query
        table = spark.read.parquet(f"{SF_SMALL}/{tables.get(name, 'documents')}.parquet")
        assert query(spark, SF_SMALL).count() == table.count(), name


def test_nothing_else_imports_the_subpackage():
    root = Path(corpus_pipeline.__file__).parent
    for file in (root / "rolloom").rglob("*.py"):
        if "llm" not in file.relative_to(root).parts:
            assert "rolloom.llm" not in file.read_text(), file


def test_copies_with_other_blanks_are_dropped(spark):
    rows = [(i, ("a b c d " * 9).strip() if i % 3 else f"text {i} of its own " * (i + 1), "en", "s", 1)
            for i in range(60)]
    frame = spark.createDataFrame(rows, DOCUMENTS)
    kept = corpus_pipeline.exact_dedup(spark, frame, SF_SMALL)
    assert kept.filter(F.col("text").startswith("a b")).count() == 1


@pytest.mark.parametrize("key", [7, None])
def test_one_row_of_each_group_whatever_its_key(spark, key):
    one, two = "one two three four five six", "seven eight nine ten eleven twelve"
    rows = [(1, one), (2, one), (2, two), (3, two), (None, one), (key, "alone at last here")]
    rows += [(key, "the same words again and again"), (key, "the same words again and again")] * 20
    rows += [(key, "the same words  again and again"), (key, "THE same words again and again")] * 20
    rows += [(None, "no id at all for these"), (None, "no  id at all for these")] * 3
    frame = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in rows], DOCUMENTS)
    exact = corpus_pipeline.exact_dedup(spark, frame, SF_SMALL)
    assert exact.columns == frame.columns
    left = sorted(((r["doc_id"], r["text"]) for r in exact.collect()), key=repr)
    assert left == sorted(
        [(1, one), (2, two), (key, "alone at last here"), (key, "the same words  again and again"),
         (key, "THE same words again and again"), (None, "no  id at all for these")], key=repr)
    for docs in (frame, exact):
        near = corpus_pipeline.near_dedup(spark, docs, SF_SMALL)
        assert near.columns == frame.columns
        kept = [(r["doc_id"], r["text"].lower().split()) for r in near.collect()]
        assert sorted(kept, key=repr) == sorted(
            [(1, one.split()), (2, two.split()), (key, "alone at last here".split()),
             (key, "the same words again and again".split()), (None, "no id at all for these".split())],
            key=repr)
