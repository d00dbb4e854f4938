"""Phrases against a plain count of every run of words."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from quaylark.llm import collocations, queries, sql

DOCS = "doc_id long, lang string, text string"


def plain(rows, longest, least, first, cover=100):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0A-\x0D]", low):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    frequent = {g: c for g, c in f.items() if c >= least}
    covered = set()
    for (lang, w), c in frequent.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = lang, w[i : i + size]
                if 100 * c >= cover * f[inner]:
                    covered.add(inner)
    out = []
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in covered:
            score, _, l, r = min((1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
            out.append((lang, " ".join(w), a, l, r, n[lang], score))
    ranked = []
    for lang in {x[0] for x in out}:
        own = sorted((x for x in out if x[0] == lang), key=lambda x: (-x[6], -x[2], x[1].encode()))
        ranked += [(x[0], i, *x[1:]) for i, x in enumerate(own[:first], 1)]
    return sorted(ranked)


def found(docs, **parameters):
    return sorted(map(tuple, collocations.collocations(docs, **parameters).collect()))


def test_same_rows_as_sql(spark, sf_dir, duck, same):
    same(queries.op12_collocations(spark, sf_dir), duck, sql.collocations_sql())


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    bits = ["the", "The", "É", "é", "of", "new", "york", "city", "a-b", "x" * 50, " ", " ", " ", "\t", "  ", ".", ",", "\n", "\x0b", "?", " ", " ", "1,5"]
    rows = [(rng.choice(["en", "en", "en", "de", None]), "".join(rng.choice(bits) + rng.choice([" ", " ", ""]) for _ in range(rng.randint(0, 200)))) for _ in range(150)]
    return rows + [("en", "new york city of the world " * 40), ("en", None), (None, ""), ("fr", " .\t, "), ("de", "new york " * 30)] * 2


@pytest.mark.parametrize("parameters", [{"least": 5, "first": 20}, {"least": 3, "first": 2000, "longest": 4}, {"least": 5, "first": 50, "cover": 60}])
def test_plain_version(spark, texts, parameters):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], DOCS).withColumnRenamed("doc_id", "gram").selectExpr("gram", "lang", "text", "gram AS n", "lang AS f")
    full = {"longest": 5, "cover": 100} | parameters
    assert found(docs, **parameters) == plain(texts, full["longest"], full["least"], full["first"], full["cover"])


def test_crowded_bits_and_short_segments_change_nothing(spark, texts):
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(texts)], DOCS)
    want = plain(texts, 5, 4, 100)
    assert found(docs, least=4, first=100, max_bits=3) == want  # 8 bits: every run passes
    assert found(docs, least=4, first=100, batch_bytes=64) == want


def test_shared_hashes_are_told_apart():
    words = collocations.Words([b"a b A b. b a", b"a b"], np.array([0, 1]))
    assert words.follows.tolist() == [True, True, True, False, True, False, True, False]
    at, got = np.array([0, 1, 2, 4, 6]), Counter()
    for first, n in collocations.tallies(words, at, 2, np.zeros(5, np.uint64)):
        got.update({(int(words.lang[i]), g): int(c) for i, g, c in zip(first, words.grams(first, 2).to_pylist(), n)} if len(n) == 1 else Counter(zip(words.lang[first].tolist(), words.grams(first, 2).to_pylist())))
    assert got == {(0, "a b"): 2, (0, "b a"): 2, (1, "a b"): 1}


def test_segments_end_with_pieces():
    text = b"one two. three four, five" + b"x" * 100 + b"! six\nseven"
    parts = list(collocations.segments(text, 12))
    assert b"".join(parts) == text and all(len(p) <= 12 or b"x" * 100 in p for p in parts)
    assert all(p[-1:] in (b".", b",", b"!", b"\n") for p in parts[:-1])
    assert list(collocations.segments(b"", 5)) == [b""]


def test_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([(1, None, None), (2, "en", "... ,")], DOCS)).count() == 0


def test_wide_products(spark):
    big = 4_000_000_000_000_000_000
    row = spark.sql(f"SELECT CAST({big} AS decimal(38,0)) AS a, CAST({big} AS decimal(38,0)) AS n, CAST({big // 7} AS decimal(38,0)) AS l").selectExpr("(a * n) div (l * l) AS s").first()
    assert row["s"] == big * big // (big // 7) ** 2
