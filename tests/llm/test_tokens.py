"""BPE, token counts and token files against the public libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quaylark.llm import bpe, queries, tokencount, tokenfiles

NAMES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
ODD = list("abcABC  '\n\t.,!?019éÉßΣσİıǅ½²٣中日한 \x85\x1ćè😀👍🏽<|>") + ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "  ", "\n\n", "'s", "'S", "'ll", "Ⅷ", "ﬁ", "ſ", "aaaa"]
EDGES = ["", " ", "\n", "aaaaaaaaa", "x" * 3000, "word " * 5000, "<|endoftext|>", " a", "a ", "it's  they'll"]


def odd_texts(n: int = 1500) -> list[str]:
    rng = random.Random(5)
    return EDGES + ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(None, "no id"), (-1, None), (-2, ""), (-2, "")]
    edge = spark.createDataFrame([*rows, *((10_000_000 + i, t) for i, t in enumerate(odd_texts(200)))], "doc_id long, text string")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(edge)


@pytest.mark.parametrize("name", NAMES)
def test_ids_and_decoding_equal_the_library(name):
    path = public_tokenizers.path(name)
    own, library = bpe.Codec(path), Tokenizer.from_file(path)
    texts = odd_texts()
    ids, counts = own.encode(texts)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    for text, got in zip(texts, parts):
        assert got.tolist() == library.encode(text, add_special_tokens=False).ids, text
    if not own.by_words:
        assert own.decode(ids, counts) == texts


def test_a_full_store_changes_nothing(monkeypatch):
    path = public_tokenizers.path(NAMES[0])
    texts = odd_texts(300)
    want = bpe.Codec(path).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 50)
    own = bpe.Codec(path)
    got = [own.encode([t])[0].tolist() for t in texts]
    assert sum(got, []) == want


def test_bytes_that_are_no_text_and_unknown_ids_decode(spark):
    own = bpe.Codec(public_tokenizers.path(NAMES[0]))
    raw = bytes([0xE4, 0xBD])
    ids = np.array([own.first[b] for b in raw] + [10**6], np.int64)
    assert own.decode(ids, np.array([3])) == [raw.decode("utf-8", "replace")]
    rows = spark.createDataFrame([(1, [int(own.first[65]), None, 10**6]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in bpe.decode(rows, public_tokenizers.path(NAMES[0])).collect()} == {1: "A", 2: "", 3: ""}


def test_round_trip_query(docs):
    path = public_tokenizers.path(NAMES[0])
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, bpe.digests(bpe.round_trip(docs, path)).collect()), key=str)
    want = []
    for doc_id, text in docs.collect():
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        want.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_encode_then_decode_gives_the_texts(docs):
    path = public_tokenizers.path(NAMES[0])
    back = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(((i, t or "") for i, t in docs.collect()), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_counts_equal_the_library(docs, name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    got = sorted(map(tuple, tokencount.count_tokens(docs, path, 100).collect()), key=str)
    want = []
    for doc_id, text in docs.collect():
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        want.append((doc_id, len((text or "").encode()), n, n > 100))
    assert got == sorted(want, key=str)


def test_proven_tokens_encode_alone():
    path = public_tokenizers.path(NAMES[1])
    library, whole = Tokenizer.from_file(path), tokencount.proven_whole_tokens(path)
    assert len(whole) > 20_000
    for text in sorted(whole)[::97]:
        assert len(library.encode(text, add_special_tokens=False).ids) == 1


def test_token_files(spark, docs, tmp_path):
    path = public_tokenizers.path(NAMES[1])
    library = Tokenizer.from_file(path)
    numbered = docs.where("doc_id IS NOT NULL")
    got = sorted(map(tuple, tokenfiles.token_files(numbered, path, 2, parts=5).collect()))
    want, start = [], 0
    for doc_id, text in sorted((i, t or "") for i, t in numbered.collect()):
        ids = library.encode(text, add_special_tokens=False).ids + [2]
        want.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == sorted(want)


def test_token_files_layout(spark, tmp_path):
    path = public_tokenizers.path(NAMES[1])
    df = spark.createDataFrame([(i, "the cat") for i in range(10)], "doc_id long, text string")
    parts = tokenfiles.write_tokens(df, path, f"file://{tmp_path}/set", 2, 3)
    assert [p[4] for p in parts] == [0, *np.cumsum([p[2] for p in parts])[:-1]]
    name = f"{tmp_path}/set/{parts[0][0]}"
    offsets = np.fromfile(f"{name}.offsets", "<u8")
    assert len(offsets) == parts[0][1] + 1 and offsets[-1] == parts[0][2]
    assert np.fromfile(f"{name}.tokens", "<u2")[2] == 2
    assert np.fromfile(f"{name}.docs", "<i8")[0] == 0


def test_token_files_place_rows_without_ids_first_and_may_be_empty(spark):
    path = public_tokenizers.path(NAMES[1])
    library = Tokenizer.from_file(path)
    rows = [(None, "a b"), (-5, "c"), (None, None), (0, "d e f"), (7, "x"), (7, "x"), (7, "y z")]
    df = spark.createDataFrame([(*r, "s", 1) for r in rows], "doc_id long, text string, part string, number int")
    got = tokenfiles.token_files(df, path, 2, 3).orderBy("start").collect()
    sums = sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_tokens"], r["ids_crc32"]) for r in got)
    want = [(i is not None, i or 0, library.encode(t or "", add_special_tokens=False).ids + [2]) for i, t in rows]
    assert sums == sorted((a, b, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for a, b, x in want)
    assert [r["doc_id"] for r in got] == [None, None, -5, 0, 7, 7, 7]
    assert [r["start"] for r in got] == [0, *np.cumsum([r["n_tokens"] for r in got])[:-1]]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert tokenfiles.token_files(empty, path, 2, 2).count() == 0
    assert bpe.round_trip(empty, path).count() == 0
    assert tokencount.count_tokens(empty, path).count() == 0


def test_token_files_of_a_set_follow_the_manifest(spark, tmp_path):
    """Files of attempts that the manifest does not name are no part of the set; parts keep their number's order."""
    path, folder = public_tokenizers.path(NAMES[1]), f"file://{tmp_path}/set"
    df = spark.createDataFrame([(i, f"word {i}") for i in range(60)], "doc_id long, text string")
    parts = tokenfiles.write_tokens(df, path, folder, 2, 12)
    (tmp_path / "set" / "part-00000-lost.tokens").write_bytes(b"\1\2")
    assert [p[5] for p in parts] == sorted(p[5] for p in parts) and sum(p[1] for p in parts) == 60
    assert [r["doc_id"] for r in tokenfiles.read_tokens(spark, folder).orderBy("start").collect()] == [*range(60)]


def test_tokens_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "some words", "a", "b", "c"), (1, "some words", "a", "b", "c"), (None, None, "a", "b", "c")], "doc_id long, text string, ids string, decoded string, n_bytes string")
    path = public_tokenizers.path(NAMES[0])
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in bpe.digests(bpe.round_trip(df, path)).collect()) == [(0, 0), (1, 2), (1, 2)]
    got = tokencount.count_tokens(df, public_tokenizers.path(NAMES[1])).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"], r["n_tokens"]) for r in got) == [(0, 0, 0), (1, 10, 2), (1, 10, 2)]


def test_long_chunks_empty_the_store(monkeypatch):
    path = public_tokenizers.path(NAMES[1])
    texts = odd_texts(200)
    want = bpe.Codec(path).encode(texts)[0].tolist()
    monkeypatch.setattr(bpe, "CHARS_KEPT", 30)
    own = bpe.Codec(path)
    assert sum((own.encode([t])[0].tolist() for t in texts), []) == want
    with bpe.task_codec(path) as kept:
        kept.encode(texts)
    assert not kept.seen and not len(kept.flat_ids)


def test_equal_rows_lie_in_several_parts(spark, tmp_path):
    path = public_tokenizers.path(queries.WORD_VOCABULARY)
    df = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("one and the same").alias("text")).repartition(12)
    parts = tokenfiles.write_tokens(df, path, f"file://{tmp_path}/hot", 2, 8)
    assert sum(p[1] for p in parts) == 3000 and len(parts) >= 6 and max(p[1] for p in parts) <= 1000
    rows = tokenfiles.read_tokens(spark, f"file://{tmp_path}/hot").collect()
    size = rows[0]["n_tokens"]
    assert sorted(r["start"] for r in rows) == list(range(0, 3000 * size, size)) and len({r["ids_crc32"] for r in rows}) == 1
