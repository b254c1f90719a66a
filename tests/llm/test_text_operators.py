"""Token counts, token blocks, SentencePiece, language ID, mixing, WARC and HTML."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyarrow.fs import FileSelector
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2 as model_pb2
from tokenizers import Tokenizer

from rolloom.llm import html_text, language_id, mixing, token_blocks, warc
from rolloom.llm.sentencepiece_codec import (
    SentencePieceCodec,
    build_normalizer,
    build_tokenizer,
    decode_ids,
    encode_texts,
    round_trip,
)
from rolloom.llm.shared_files import locate
from rolloom.llm.token_counts import CountingTransducer, count_tokens
from rolloom.llm.word_memo import WordMemo
from rolloom.session import scratch_path

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PIECES)

HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", " " * 40, "x" + " " * 37 + "y", "aaaa" * 10,
    "-" * 77, "=" * 50 + " " + "." * 33, "日本語 テキスト", "\n\n\n a", "a\nb", "a\n\nb", "a \nb",
    "a\n b", "\t", "a\r\nb", "\n", "\na", "▁▁a", "a▁b", "<s> </s> <unk>", "<0x41>", "é́ x", "\U0001f600",
    "\x00a", "1234 56", "ééé" * 9, "it's  'll we'll,", "<|endoftext|> a", "a<|endoftext|>b", "Ġx y",
    "a b", "a\x1cb c", "word, word. word", "the cat " * 3000, "x" * 70_000,
]


def random_texts(seed):
    rng = random.Random(seed)
    alphabets = ("a ", "ab ", "the in ", "-=. ", "aeht ▁\n", "éàa日 x", "er,. \n")
    return [
        "".join(rng.choice(a) for _ in range(rng.randrange(80))) for a in alphabets for _ in range(60)
    ]


def frame(spark, texts):
    rows = [(i, x, f"k{i}") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, key string")


# --- token counts --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def transducer():
    return CountingTransducer(PIECES)


def test_forgotten_states_go_and_change_no_count(monkeypatch):
    monkeypatch.setattr("rolloom.llm.token_counts.MAX_STATES", 50)
    small = CountingTransducer(PIECES)
    texts = random_texts(5)
    assert small.counts(texts) == [len(x) for x in LIBRARY.encode(texts)]
    seen, todo = {id(small.start)}, [small.start]
    while todo:
        for char, step in todo.pop().items():
            if char is not None and id(step[0]) not in seen:
                seen.add(id(step[0]))
                todo.append(step[0])
    assert len(seen) <= 51 and len(small._known) <= 51


def test_counts_are_the_librarys(transducer):
    texts = [x or "" for x in HARD] + random_texts(1)
    assert transducer.counts(texts) == [len(x) for x in LIBRARY.encode(texts)]


@pytest.mark.parametrize("width", [1, 3, 7, 50])
def test_chunk_maps_compose_in_any_order(transducer, width):
    rng = random.Random(width)
    for text in [x for x in HARD if x and len(x) < 500] + random_texts(2):
        if not text:
            continue
        chunks = [text[i : i + width] for i in range(0, len(text), width)]
        maps = [
            transducer.chunk_map(x, chunks[i - 1][-1] if i else None) for i, x in enumerate(chunks)
        ]
        want = len(LIBRARY.encode(text))
        assert transducer.compose_all(list(maps))["tokens"] == want
        while len(maps) > 1:
            i = rng.randrange(len(maps) - 1)
            maps[i : i + 2] = [transducer.compose(maps[i], maps[i + 1])]
        assert maps[0]["tokens"] == want


def test_states_may_be_forgotten(monkeypatch):
    from rolloom.llm import token_counts

    monkeypatch.setattr(token_counts, "MAX_STATES", 5)
    texts = random_texts(3)
    small = CountingTransducer(PIECES)
    assert small.counts(texts) == [len(x) for x in LIBRARY.encode(texts)]


@pytest.mark.parametrize("chunk_chars", [5, 1 << 16])
def test_count_tokens(spark, chunk_chars):
    texts = HARD + HARD[:3]
    rows = frame(spark, texts).withColumn("doc_id", F.expr("IF(doc_id < 2, NULL, doc_id)"))
    found = count_tokens(rows, PIECES, chunk_chars=chunk_chars, limit=100).collect()
    want = [
        (i if i >= 2 else None, len((x or "").encode()), len(LIBRARY.encode(x or "")))
        for i, x in enumerate(texts)
    ]
    assert sorted(map(tuple, found), key=repr) == sorted(
        ((*x, x[2] > 100) for x in want), key=repr
    )
    assert count_tokens(rows.limit(0), PIECES).count() == 0


# --- token blocks --------------------------------------------------------------------------------


def test_blocks_round_trip():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 4095, 4096, *rng.integers(1, 4096, 60)]
    for size in sizes:
        ids = rng.integers(0, 2 ** rng.integers(1, 33), size, dtype=np.uint64).astype(np.uint32)
        assert (token_blocks.unpack_block(token_blocks.pack_block(ids)) == ids).all()
    few = np.full(4096, 7, np.uint32)
    few[5] = 2**32 - 1
    assert len(token_blocks.pack_block(few)) < 100  # one exception does not widen the block


def test_byte_level_ids_are_the_librarys():
    texts = [x or "" for x in HARD] + random_texts(4)
    library = Tokenizer.from_file(BYTES)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    encode = token_blocks.ByteLevelEncoder(BYTES)
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in encode(texts)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json"])
def test_other_tokenizers_take_whole_texts(name):
    path = public_tokenizers.path(name)
    texts = [x or "" for x in HARD[:30]]
    library = Tokenizer.from_file(path)
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    found = token_blocks.ByteLevelEncoder(path)(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in found] == want


@pytest.mark.parametrize("shard_ids", [1 << 22, 50])
def test_token_files(spark, monkeypatch, shard_ids):
    monkeypatch.setattr(token_blocks, "SHARD_IDS", shard_ids)
    texts = HARD + ["repeated", "repeated"]
    rows = frame(spark, texts)
    rows = rows.withColumn("doc_id", F.expr(f"IF(doc_id = 4, NULL, IF(doc_id > {len(HARD)}, 1000, -doc_id))"))
    folder = scratch_path(spark, "blocks")
    manifest = token_blocks.write_token_blocks(rows, folder, BYTES, 2)
    found = token_blocks.read_token_blocks(manifest, folder).collect()
    library = Tokenizer.from_file(BYTES)
    keyed = sorted(
        ((r["doc_id"], r["text"] or "") for r in rows.collect()),
        key=lambda x: (x[0] is not None, x[0] or 0, x[1]),
    )
    want, start = [], 0
    for key, text in keyed:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, found), key=lambda r: r[1]) == want
    names = sorted(r["name"] for r in manifest.collect())
    store, path = locate(folder)
    files = [x.base_name for x in store.get_file_info(FileSelector(path))]
    kept = sorted(f for f in files if f.endswith(".pfor"))
    assert kept == names and len(names) > (8 if shard_ids == 50 else 0)
    if shard_ids > 50:
        one = manifest.orderBy("shard_no").first()
        shard = token_blocks.ShardReader(f"{folder}/{one['name']}")
        whole = np.concatenate([ids for _, _, ids in shard.documents()])
        for at, count in ((0, 1), (5, 0), (17, 300), (len(whole) - 3, 3), (4000, 9000)):
            part = whole[at : at + count]
            assert (shard.read(at, len(part)) == part).all()
        shard.close()


def test_token_files_of_no_rows(spark):
    folder = scratch_path(spark, "blocks")
    manifest = token_blocks.write_token_blocks(frame(spark, ["x"]).limit(0), folder, BYTES)
    assert token_blocks.read_token_blocks(manifest, folder).count() == 0


# --- SentencePiece -------------------------------------------------------------------------------


def test_piece_ids_are_the_librarys():
    codec = SentencePieceCodec(PIECES, threads=1)
    texts = [x or "" for x in HARD] + random_texts(5)
    raws = codec.encode(texts)
    assert [np.frombuffer(x, "<i4").tolist() for x in raws] == LIBRARY.encode(texts)
    assert codec.returns(texts, raws) == ["▁" not in x for x in texts]
    assert codec.encode_checked(texts)[1] == [0] * len(texts)
    decoded = codec.decode([np.frombuffer(x, "<i4").tolist() for x in raws])
    assert decoded == [x.replace("▁", " ") for x in texts]


def unigram_model(path, byte_fallback=True, extra=False):
    """A small Unigram model put together by hand."""
    proto = model_pb2.ModelProto()
    proto.trainer_spec.model_type = model_pb2.TrainerSpec.UNIGRAM
    proto.trainer_spec.byte_fallback = byte_fallback
    proto.normalizer_spec.name = "identity"
    proto.normalizer_spec.add_dummy_prefix = True
    proto.normalizer_spec.escape_whitespaces = True
    proto.normalizer_spec.remove_extra_whitespaces = extra
    kinds = model_pb2.ModelProto.SentencePiece
    for name, kind in (("<unk>", kinds.UNKNOWN), ("<s>", kinds.CONTROL), ("</s>", kinds.CONTROL)):
        proto.pieces.add(piece=name, score=0.0, type=kind)
    if byte_fallback:
        for byte in range(256):
            proto.pieces.add(piece=f"<0x{byte:02X}>", score=0.0, type=kinds.BYTE)
    words = "▁ a b c d e ▁a ▁b ab bc abc ▁abc cd de ▁de cde ▁c dea".split()
    for rank, word in enumerate(words):
        proto.pieces.add(piece=word, score=-1.5 - 0.37 * len(words) / (rank + 1) - 0.01 * rank)
    with open(path, "wb") as file:
        file.write(proto.SerializeToString())
    return proto


@pytest.mark.parametrize("extra", [False, True])
def test_unigram_models(tmp_path, extra):
    path = str(tmp_path / "unigram.model")
    proto = unigram_model(path, extra=extra)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    texts = ["".join(rng.choice("abcde  x") for _ in range(rng.randrange(1, 40))) for _ in range(200)]
    normal, tokenizer = build_normalizer(proto.normalizer_spec), build_tokenizer(proto)
    same = sum(
        tokenizer.encode(normal.normalize_str(x), add_special_tokens=False).ids == library.encode(x)
        for x in texts
    )
    assert same >= 0.9 * len(texts)  # the rest are paths of one score
    codec = SentencePieceCodec(path, threads=1)
    raws, differing = codec.encode_checked(texts)
    # the rebuilt tokenizer's ids stand; where sentencepiece has others, the text is marked
    for text, raw, marks, want in zip(texts, raws, differing, library.encode(texts)):
        assert (np.frombuffer(raw, "<i4").tolist() == want) == (marks == 0)
        assert library.decode(np.frombuffer(raw, "<i4").tolist()) == library.decode(want)
    assert sum(map(bool, differing)) <= 0.1 * len(texts)


def test_a_differing_word_marks_its_texts():
    codec = SentencePieceCodec(PIECES, threads=1)
    backend = codec._backend
    codec._backend = lambda texts: [
        ids[:-1] if "zebra" in text else ids for text, ids in zip(texts, backend(texts))
    ]
    texts = ["a zebra, a zebra", "no such word", "", "zebra  twice zebra", "one zebra."]
    raws, differing = codec.encode_checked(texts)
    assert [bool(n) for n in differing] == [True, False, False, True, True]
    assert codec.returns(texts, raws) == [False, True, True, False, False]


def test_encode_and_decode_columns(spark):
    rows = frame(spark, HARD).withColumns({"_ids": F.lit(3), "ids": F.lit("x"), "_text": F.lit(1)})
    encoded = encode_texts(rows, PIECES, differing="differing")
    assert encoded.columns == ["doc_id", "text", "key", "_ids", "_text", "ids", "differing"]
    back = decode_ids(encoded, PIECES, out="back").collect()
    want = LIBRARY.encode([x or "" for x in HARD])
    assert [r["ids"] for r in sorted(back, key=lambda r: r["doc_id"])] == want
    assert all(r["back"] == (r["text"] or "").replace("▁", " ") for r in back)
    assert sum(r["differing"] for r in back) == 0
    assert encode_texts(rows.limit(0), PIECES).count() == 0
    slim = encode_texts(rows, PIECES, keep_text=False)
    assert slim.columns == ["doc_id", "key", "_ids", "_text", "ids"]
    assert [r["ids"] for r in sorted(slim.collect(), key=lambda r: r["doc_id"])] == want


def test_round_trip_rows(spark):
    rows = frame(spark, [*HARD, "a", "a"]).withColumn("doc_id", F.expr("nullif(doc_id, 3)"))
    found = round_trip(rows, PIECES).collect()
    assert len(found) == len(HARD) + 2
    assert sum(not r["round_trip"] for r in found) == sum("▁" in (x or "") for x in HARD) > 0
    by_id = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in found}
    for i, text in enumerate(HARD):
        ids = LIBRARY.encode(text or "")
        assert by_id[None if i == 3 else i] == (len(ids), zlib.crc32(np.array(ids, "<i4").tobytes()))


def test_memo_forgets_without_harm():
    made: list[str] = []

    def make(words):
        made.extend(words)
        return [w.upper() for w in words]

    memo = WordMemo(make, capacity=3)
    for words in ({"a", "b"}, {"c", "d", "x" * 300}, {"a", "e"}, {"f"}, {"g", "a"}, {"x" * 300}):
        known = memo.covering(words)
        assert all(known[w] == w.upper() for w in words)
    assert made.count("a") <= 2 and made.count("x" * 300) == 2


# --- language ID ---------------------------------------------------------------------------------


def brute_phrases(sample, word):
    count, at = 0, 0
    while at < len(word):
        end = at
        while end < len(word) and word[at : end + 1] in sample:
            end += 1
        count += 1
        at = max(end, at + 1)
    return count


def test_automaton_against_substrings():
    rng = random.Random(7)
    for _ in range(60):
        words = ["".join(rng.choice("abc ") for _ in range(rng.randrange(30))) for _ in range(rng.randrange(1, 9))]
        start = language_id.suffix_automaton(words)
        sample = "\n".join(words)
        for _ in range(30):
            word = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 15)))
            assert language_id.phrases(start, word) == brute_phrases(sample, word)


def brute_language(rows):
    """Predictions of (key, text, label) rows, from substrings of the samples alone."""

    def words(text):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        return found if any(c.isalpha() for w in found for c in w) else []

    learned: dict = {}
    for key, text, label in rows:
        if label is not None and zlib.crc32(str(key).encode()) % 3 != 1 and words(text):
            learned.setdefault(label, []).append(words(text))
    samples, usual = {}, {}
    for label, texts in learned.items():
        # which rows are held back goes by a hash that is Spark's own: small samples hold back none
        assert len(texts) < 8
        samples[label] = "\n".join(" " + w for text in texts for w in text)
        every = [w for text in texts for w in text]
        usual[label] = sum(brute_phrases(samples[label], " " + w) for w in every) / len(every)
    mean = sum(usual.values()) / len(usual)
    out = []
    for key, text, _ in rows:
        if not words(text):
            out.append((key, "und", 0.0))
            continue
        inverse = {
            label: usual[label] / mean / sum(brute_phrases(sample, " " + w) for w in words(text))
            for label, sample in samples.items()
        }
        best = max(inverse, key=lambda k: (inverse[k], k))
        out.append((key, best, round(inverse[best] / sum(inverse.values()), 9)))
    return sorted(out, key=repr)


def test_predictions_equal_brute_force(spark):
    rng = random.Random(12)
    letters = {"aa": "abcdeé", "bb": "abfghi", "cc": "xyzabc"}
    rows = []
    for i in range(16):
        label = ("aa", "bb", "cc")[i % 3]
        text = " ".join("".join(rng.choices(letters[label], k=rng.randrange(1, 6))) for _ in range(40))
        rows.append((i, text, label))
    for i in range(16, 120):
        pool = "".join(rng.sample(list(letters.values()), 2))
        text = " ".join("".join(rng.choices(pool, k=rng.randrange(1, 7))) for _ in range(rng.randrange(12)))
        rows.append((i, text + rng.choice(["", " 12", " ?", " Ä"]), None))
    found = language_id.identify_documents(
        spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    )
    got = [(r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in found.collect()]
    assert sorted(got, key=repr) == brute_language(rows)
    assert len({label for _, label, _ in got}) == 4


def test_whole_texts_are_learned_from(spark):
    """What tells a language stands at the end of its one long text; fifty others have their rows."""
    rows = [(i, f"{'same words here ' * 300} {chr(97 + i // 7)}{chr(97 + i % 7)}zq" * 2, f"l{i}") for i in range(50)]
    keys = [k for k in range(500) if zlib.crc32(str(k).encode()) % 3 != 1][:50]
    frame = spark.createDataFrame(
        [(k, *r[1:]) for k, r in zip(keys, rows)], "doc_id bigint, text string, lang string"
    )
    samples = language_id.language_samples(frame)
    assert len(samples) == 50 and all(sum(c.values()) > 1200 for s in samples.values() for c in s)
    asked = [(1000 + i, f"{chr(97 + i // 7)}{chr(97 + i % 7)}zq", None) for i in range(50)]
    frame = frame.unionByName(spark.createDataFrame(asked, frame.schema))
    found = language_id.identify_documents(frame).filter("doc_id >= 1000").collect()
    assert all(r["lang_pred"] == f"l{r['doc_id'] - 1000}" for r in found)


def test_language_rows(spark):
    texts = ["the cat and the dog sat on the mat", "der hund und die katze auf dem dach"]
    rows = [(i, f"{texts[i % 2]} {i}", ("en", "de")[i % 2], "s", "old") for i in range(60)]
    rows += [
        (100, None, "en", "s", "x"), (101, "", "en", "s", "x"), (102, "12 ½ !", "de", "s", "x"),
        (103, "the dog and the cat", None, "s", "x"), (103, "die katze", None, "s", "x"),
        (None, "der hund", "de", "s", "x"), (104, "the " * 50_000, None, "s", "x"),
    ]
    frame = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, lang_pred string"
    )
    found = language_id.identify_documents(frame).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r["lang_pred"])
        assert 0 <= r["score"] <= 1
        key = str(r["doc_id"]).encode()
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(key) % 3 == 1)
    assert all(by_id[i] == [("en", "de")[i % 2]] for i in range(60))
    assert by_id[100] == by_id[101] == by_id[102] == ["und"]
    assert sorted(by_id[103]) == ["de", "en"] and by_id[None] == ["de"] and by_id[104] == ["en"]
    kept = language_id.tag_language(frame)
    assert kept.columns == frame.columns and kept.count() == len(rows) - 3
    said = {}
    for r in kept.collect():
        said.setdefault(r["doc_id"], []).append(r["lang"])
    assert all(sorted(said[i]) == sorted(by_id[i]) for i in said)
    unlabelled = frame.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language_id.identify_documents(unlabelled).collect()} == {"und"}
    assert language_id.identify_documents(frame.limit(0)).count() == 0


def test_without_samples_only_texts_without_letters_go(spark):
    held = next(i for i in range(9) if zlib.crc32(str(i).encode()) % 3 == 1)
    rows = [(10, "some words"), (11, None), (12, "12 ½ !"), (13, "é"), (None, "x"), (held, "der hund")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = F.when(F.col("doc_id").isin(held, 12), "de")
    for label in (F.lit(None).cast("string"), labels, F.when(F.col("doc_id") == 10, "und")):
        kept = language_id.tag_language(frame.withColumn("lang", label))
        assert {r["doc_id"] for r in kept.collect()} == {10, 13, None, held}


def test_every_language_has_its_sample(spark):
    """Rows that share keys or texts, or have no letters, take no language's sample away."""
    texts = {"en": "the cat and dog", "de": "der hund und katze", "fr": "le chien et la", "es": "12 el perro"}
    frame = spark.range(12_000).selectExpr(
        "id % 4 AS l", "id", "CASE id % 4 WHEN 0 THEN 17 WHEN 1 THEN id % 8 WHEN 3 THEN id END AS doc_id"
    )
    text = F.expr("CASE l WHEN 0 THEN concat('the cat and dog ', id) WHEN 1 THEN 'der hund und katze' "
                  "WHEN 2 THEN concat('le chien et la ', id) ELSE if(id = 4003, '12 el perro', string(id)) END")  # fmt: skip
    frame = frame.withColumns({"text": text, "lang": F.expr("element_at(array('en', 'de', 'fr', 'es'), int(l) + 1)")})
    samples = language_id.language_samples(frame)
    assert sorted(samples) == sorted(texts)
    assert len(samples["en"]) == len(samples["fr"]) == language_id.SAMPLE_ROWS
    assert samples["es"] == [{"el": 1, "perro": 1}]
    assert all(words == dict.fromkeys(texts["de"].split(), 1) for words in samples["de"])


def test_held_out_accuracy(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify_documents(documents).filter("held_out").join(documents, "doc_id")
    right, known = found.filter("lang IS NOT NULL").selectExpr(
        "count_if(lang = lang_pred)", "count(*)"
    ).first()
    assert right >= 0.97 * known


# --- mixing --------------------------------------------------------------------------------------


def brute_targets(sizes):
    """Resharing round by round, as the contract words it."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in capped]
        room = total - sum(capped.values())
        share = {s: room * weight[s] / sum(weight[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 3 * sizes[s]]
        if not above:
            return capped | share
        capped |= {s: 3 * sizes[s] for s in above}


def mix_rows(seed):
    rng = random.Random(seed)
    rows = []
    for source, count in (("a", 400), ("b", 60), ("Z", 3), (None, 25), ("é", 200), ("empty", 2)):
        for _ in range(count):
            words = 0 if source == "empty" else rng.choice([0, 1, 5, 30, 200])
            rows.append((len(rows), "w \t" * words, source))
    rows.append((len(rows), None, "a"))
    rows.append((None, "x y z", "a"))
    rows.append((3, "twice the key", "a"))
    return rows


def test_mix(spark):
    rows = mix_rows(2)
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(frame.withColumn("target", F.lit(9))).collect()
    assert sorted(map(tuple, mixing.mix(frame).collect()), key=repr) == sorted(
        map(tuple, found), key=repr
    )
    sizes: dict = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    assert len(found) == len(rows) and all(r["taken"] <= 3 * r["size"] for r in found)
    targets = sorted({(r["source_size"], round(r["target"], 6)) for r in found})
    assert targets == sorted({(sizes[s], round(float(t), 6)) for s, t in want.items()})
    assert abs(sum(want.values()) - sum(sizes.values())) < 1e-6
    taken: dict = {}
    for r in found:
        taken[r["source_size"]] = taken.get(r["source_size"], 0) + r["taken"]
    for source, size in sizes.items():
        assert abs(taken[size] - want[source]) <= 200  # the largest document


def test_threshold_is_the_nearest(spark):
    rows = [(i, "w " * (1 + i % 7), "s" if i % 3 else "t") for i in range(500)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = mixing.mix(frame).collect()
    for size in {r["source_size"] for r in found}:
        part = [r for r in found if r["source_size"] == size]
        assert abs(sum(r["taken"] for r in part) - part[0]["target"]) <= 3.5


@pytest.mark.parametrize("key", ["7", "nullif(1, 1)"])
def test_a_repeated_key_is_split(spark, key):
    """A third of a source's words, or all of them, under one key: a target is missed by half a row."""
    rows = spark.range(3000).selectExpr(
        f"if(id % 3 = 0 OR id >= 1500, {key}, id) AS doc_id", "concat('w v ', id) AS text",
        "if(id < 1500, 'a', if(id < 1800, 'b', 'c')) AS source",
    )
    found = mixing.mix(rows).groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(found) == 3
    assert all(abs(r["taken"] - r["target"]) <= 1.5 for r in found)
    drawn = mixing.draw_mix(rows).groupBy("source").count().collect()
    assert sorted(3 * r["count"] for r in drawn) == sorted(r["taken"] for r in found)


def test_draw_mix_repeats_rows(spark):
    frame = spark.createDataFrame(mix_rows(3), "doc_id bigint, text string, source string")
    frame = frame.withColumns({"target": F.lit(1), "_whole2": F.lit(2)})
    drawn = mixing.draw_mix(frame)
    assert drawn.columns == frame.columns
    want = mixing.mix(frame).filter("doc_id IS NOT NULL AND doc_id <> 3")
    counts = {r[0]: r[1] for r in drawn.groupBy("doc_id").count().collect()}
    for r in want.collect():
        assert counts.get(r["doc_id"], 0) == r["epochs"]
    empty = frame.limit(0)
    assert mixing.mix(empty).count() == 0 and mixing.draw_mix(empty).count() == 0


# --- WARC ----------------------------------------------------------------------------------------

PAGES = [
    (1, "http://a.example/x", "p" * 1200), (2, "http://a.example/y z\r\n", "p" * 1200),
    (3, None, "p" * 1200), (4, "http://b.example/é", "short"), (5, "http://b.example/", "short"),
    (6, "http://b.example/", None), (7, "http://b.example/", ""), (8, "u", "q\r\n\r\nWARC/1.1\r\n" * 90),
    (9, "u", "q\r\n\r\nWARC/1.1\r\n" * 90), (9, "u", "q\r\n\r\nWARC/1.1\r\n" * 90), (None, "u", "p" * 1200),
    (10, "u", "é" * 500), (11, "u", "é" * 500), (12, "u", "é" * 499), (13, "u", "é" * 499),
    (14, "u", "z" * 3_000_000),
]


def brute_warc(rows):
    top: dict = {}
    for key, _, page in rows:
        raw = (page or "").encode()
        if len(raw) >= 1000 and key is not None:
            top[raw] = max(top.get(raw, key), key)
    out = []
    for key, _, page in rows:
        raw = (page or "").encode()
        target = top.get(raw)
        revisit = key is not None and target is not None and key < target
        digest = hashlib.sha1(raw).hexdigest()
        kind = "revisit" if revisit else "response"
        out.append((key, len(raw), digest, kind, target if revisit else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("roll", [1 << 26, 1])
def test_warc(spark, roll):
    pages = spark.createDataFrame(PAGES, "page_id bigint, url string, html string")
    pages = pages.withColumns({"digest": F.lit("clash"), "key": F.lit(0)})
    folders = [scratch_path(spark, "warc") for _ in range(2)]
    manifests = [warc.write_warc(pages, f, roll_bytes=roll) for f in folders]
    found = warc.read_warc(manifests[0], folders[0]).collect()
    assert sorted(map(tuple, found), key=repr) == brute_warc(PAGES)
    files = [sorted(r["name"] for r in m.collect()) for m in manifests]
    assert files[0] == files[1] and sum(r["n_records"] for r in manifests[0].collect()) == len(PAGES)
    for name in files[0]:  # the same bytes each time, readable by any gzip
        raws = []
        for folder in folders:
            store, path = locate(f"{folder}/{name}")
            with store.open_input_stream(path, compression=None) as file:
                raws.append(file.read())
        assert raws[0] == raws[1] and gzip.decompress(raws[0]).startswith(b"WARC/1.1\r\n")
    if roll == 1:
        assert len(files[0]) == len(PAGES)


@pytest.mark.parametrize("key", [None, 7])
def test_pages_of_one_key_are_dealt_to_several_tasks(spark, key):
    """Different pages under one key, each twice, and once more under a larger key."""
    rows = [(key, f"u{i % 2}", f"{i % 200} " * 400) for i in range(400)]
    rows += [(1000 + i, "v", f"{i} " * 400) for i in range(100)]
    folder = scratch_path(spark, "warc")
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    manifest = warc.write_warc(pages, folder)
    found = warc.read_warc(manifest, folder).collect()
    assert sorted(map(tuple, found), key=repr) == brute_warc(rows)
    most = max(r["n_records"] for r in manifest.collect())
    assert most < len(rows) // 2


def test_warc_of_no_pages(spark):
    pages = spark.createDataFrame([], "page_id bigint, url string, html string")
    folder = scratch_path(spark, "warc")
    manifest = warc.write_warc(pages, folder)
    assert manifest.count() == 0 and warc.read_warc(manifest, folder).count() == 0


def test_damage_is_found():
    record = warc.parse_record(next(warc.members(_memory(warc.page_record(1, "u", b"abc", None)))))
    assert warc.page_row(*record)["payload_bytes"] == 3
    with pytest.raises(ValueError):
        warc.page_row(record[0], record[1].replace(b"abc", b"abd"))
    with pytest.raises(ValueError):
        list(warc.members(_memory(warc.page_record(1, "u", b"abc" * 500, None)[:-20])))


def _memory(raw):
    import io

    return io.BytesIO(raw)


# --- HTML ----------------------------------------------------------------------------------------

ARTICLE = (
    '<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style></head><body>'
    '<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav>'
    '<div class="cookie-notice">We use cookies</div><div class="wrap"><{tag} class="{mark}">'
    "<h1>Head &amp; shoulders</h1><p>First   para\n graph &lt;b&gt; <b>bold</b>ly"
    '<p>Second <a href="x">link</a> text<br>more<script>var a="<p>no</p>"</script>'
    '<div class="ad-slot">Buy</div><form><p>Mail</p></form><aside>Side</aside>'
    "<ul><li>one<li>two</ul><!-- <p>gone</p> --></{tag}>"
    '<div class="sidebar"><p>Popular things that are quite long and go on and on and on</p></div></div>'
    '<section id="comments"><p>Reader says a very long thing about all of this, over and over'
    " again, with many words</p></section><footer>&copy; Site</footer>"
)
TEXT = "Head & shoulders\nFirst para graph <b> boldly\nSecond link text more\none\ntwo"


@pytest.mark.parametrize(
    ("tag", "mark"), [("article", ""), ("main", "x"), ("div", "post-content"), ("div", "c1")]
)
@pytest.mark.parametrize("end", ["</body></html>", ""])
def test_extract_alone(tag, mark, end):
    assert html_text.extract(ARTICLE.format(tag=tag, mark=mark) + end, None) == TEXT


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &am &amp text", "plain &am & text"), ("<p>a<p>b", "a\nb"),
        ("<nav>x</nav>", ""), ("<body><p>a</p><script>no", "a"), ("<p>a</p><!-- no", "a"),
        ("<article><p>cut off <b", "cut off"), ("<p hidden>no</p><p>yes</p>", "yes"),
        ("a < b and 3 > 2", "a < b and 3 > 2"), ("<p>x</p></div></p></p><p>y</p>", "x\ny"),
        ("<DIV><P>Up</P></DIV>", "Up"), ("<div><div><div><p>deep</p></div></div></div>", "deep"),
    ],
)
def test_extract_odd_pages(page, text):
    assert html_text.extract(page, None) == text


LONG = "A sentence of the article that goes on for a while, as they do."
NOISY = '<nav><a href="/">Home</a></nav><div class="sidebar"><p>Other things</p></div>'


@pytest.mark.parametrize(
    ("opened", "closed"),
    [
        ('<article class="prose overflow-hidden">', "</article>"),
        ('<main class="content has-sidebar">', "</main>"), ('<div id="content" class="no-ads">', "</div>"),
        ('<section class="with-sidebar">', "</section>"), ('<div title="the hidden life">', "</div>"),
        ('<div data-hidden="false" data-class="ad">', "</div>"), ("<form action=x><div>", "</div></form>"),
        ('<form action="x">', "</form>"), ('<div class="sidebar">', "</div>"), ("<div hidden>", "</div>"),
        ('<article class="article share">', "</article>"), ("<div class=a/b id='x' id=ads>", "</div>"),
    ],
)
def test_noise_words_drop_no_article(opened, closed):
    page = f"<html><head><title>t</title></head><body>{NOISY}{opened}<p>{LONG}</p>{closed}</body>"
    assert html_text.extract(page, None) == LONG


@pytest.mark.parametrize("mark", ['class="ad-slot"', "id=ad-300x250", "CLASS='x site-footer'", "role=search",
                                  "aria-hidden=true", "style='display: none'", "hidden"])
def test_noise_is_dropped(mark):
    page = f"<body><div><p>{LONG}</p><p>{LONG}</p><div {mark}><p>Noise of its own</p></div></div>"
    assert html_text.extract(page, None) == f"{LONG}\n{LONG}"


def test_headings_with_slugs_stay():
    page = f'<article><h2 id="related-work">A</h2><h2 id="sharing">B</h2><h3 id="sharing-data">C</h3><p>{LONG}</p>'
    assert html_text.extract(page, None) == f"A\nB\nC\n{LONG}"


@pytest.mark.parametrize("first", ["<body>", "", "<body class='x'><main>", "<div>"])
def test_a_head_without_end(first):
    page = f"<html><head><meta charset=utf-8><title>t</title><style>p{{}}</style>{first}<p>{LONG}</p>"
    assert html_text.extract(page, None) == LONG


def test_a_host_of_forms(spark):
    """Pages wrapped in a form agree on a path that a page with more outside of it follows."""
    page = '<body><form><div class="text"><p>{0}</p></div></form><div class="x"><p>{1}</p></div></body>'
    rows = [(i, "http://h/", page.format(LONG, "x")) for i in range(9)]
    rows.append((9, "http://h/", page.format("short", LONG)))
    found = html_text.extract_text(spark.createDataFrame(rows, "page_id int, url string, html string"))
    assert {r["page_id"]: r["text"] for r in found.collect()} == {9: "short"} | dict.fromkeys(range(9), LONG)


def test_extract_is_linear():
    import time

    def seconds(n):
        begin = time.process_time()
        for page in ("<div>" * n, "<p>x" * n, "<" * n, "<a '" * n, "&" * n, "<!--" * n, "</p>" * n):
            html_text.extract(page, None)
        return time.process_time() - begin

    seconds(100)
    assert seconds(8000) < 30 * max(seconds(1000), 0.02)


def test_host_consensus(spark):
    """A page whose own best container misleads is taken by the path its host agrees on."""
    good = '<div class="layout"><div class="c{i}"><p>{text}</p></div><div class="box"><p>{more}</p></div></div>'
    rows = [
        (i, f"http://H.example:80/{i}", good.format(i=i, text="body " * 40, more="x"), "e")
        for i in range(20)
    ]
    odd = good.format(i=99, text="short body", more="louder words " * 30)
    rows += [
        (50, "http://h.example/odd", odd, "e"), (51, "http://other.example/", odd, "e"),
        (52, None, "<p>no host</p>", "e"), (53, "http://h.example/n", None, "e"), (53, "x", "", "e"),
        (None, "http://h.example/none", "<p>elsewhere</p>", "e"),
    ]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, path string")
    found = html_text.extract_text(frame).collect()
    assert len(found) == len(rows)
    texts = {(r["page_id"], r["url"]): r["text"] for r in found}
    assert texts[(50, "http://h.example/odd")] == "short body"
    assert texts[(51, "http://other.example/")].startswith("louder")
    assert texts[(52, None)] == "no host" and texts[(None, "http://h.example/none")] == "elsewhere"
    assert texts[(53, "http://h.example/n")] == "" and texts[(53, "x")] == ""
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    assert html_text.extract_text(frame.limit(0)).count() == 0


# --- token counts of texts without blanks ------------------------------------------------------------


def blankless(rng, kind, n):
    if kind == "ideographs":
        return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))
    if kind == "kana":
        return "".join(rng.choice("あいうえおかきくけこのはがですをに") for _ in range(n))
    if kind == "base64":
        return "".join(rng.choices("ABCDEFGHabcdefghijklmnopqrstuvwxyz0123456789+/", k=n))
    return "".join(rng.choices("etaoinshrdlucmfwypvbgkqjxz", k=n))


@pytest.mark.parametrize("kind", ["ideographs", "kana", "base64", "letters"])
def test_maps_of_texts_without_blanks_are_bounded(kind):
    from rolloom.llm.token_counts import CountingTransducer

    rng = random.Random(3)
    transducer = CountingTransducer(PIECES)
    text = blankless(rng, kind, 30_000)
    chunks = [text[i : i + 500] for i in range(0, len(text), 500)]
    maps = [
        transducer.chunk_map(c, chunks[i - 1][-1] if i else None) for i, c in enumerate(chunks)
    ]
    assert max(len(m["head"]) for m in maps) < 100 and all(m["state"] for m in maps)
    assert transducer.compose_all(maps)["tokens"] == len(LIBRARY.encode(text))


def test_a_long_text_without_a_blank(spark):
    from rolloom.llm.token_counts import count_tokens

    rng = random.Random(5)
    texts = [blankless(rng, "base64", 1_000_000), blankless(rng, "kana", 300_000), "a" * 70_000, "▁" * 9]
    texts += [" ".join(blankless(rng, "ideographs", 9) for _ in range(9)), " a  b ", "▁a b▁"]
    found = count_tokens(frame(spark, texts), PIECES, chunk_chars=4096).collect()
    got = {r["doc_id"]: r["n_tokens"] for r in found}
    assert got == {i: len(LIBRARY.encode(x)) for i, x in enumerate(texts)}
