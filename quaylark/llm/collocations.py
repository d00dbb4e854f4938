"""Phrase collocations by level-wise (Apriori) passes over the texts.

Level 1 counts words, level k the runs of k words within a piece of text. A level emits a run
only if both runs of k - 1 words in it were frequent, as no frequent run can hold a rare one;
the frequent runs are sent to all tasks as a table of bits set by their hashes, whose size is
bounded by ``MAX_BITS`` whatever the corpus holds. A bit set by another run lets a candidate
through that its exact count then drops, so the counts are exact at any size of the table.
Within a task runs are grouped by hash and compared word by word, counts are merged before
the shuffle, and each level's frequent runs are stored. Scores come from these level tables:
each cut of a phrase joins its two parts, phrases inside a longer one of equal count go, and
the first of each language are found in salted groups before one ranks them.

Everything is per language (null: ``und``). Arithmetic is on decimals of 38 digits.

Edge cases: null and empty texts have no words; a text of separators only has none either;
very long texts are passed in segments cut between pieces; repeated rows count as often as
they stand; rows without any id are counted; other columns of the documents are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import by_size, in_batches, stored

#: Bytes between pieces, and between the words of a piece.
PIECE_ENDS, BLANKS = b".,;:!?\n\v\f\r", b" \t"
LONGEST, LEAST, FIRST = 5, 100, 2000
#: A longer phrase with this percentage of a phrase's count makes it redundant.
COVER = 100
#: The table of frequent runs has up to 2**MAX_BITS bits (32 MB), and BITS_EACH or more for each run below that.
MAX_BITS, BITS_EACH = 28, 32
#: Bytes of text that a task has in hand, and of a segment of a long text.
BATCH_BYTES = 4_000_000
#: Groups that a language's phrases are dealt into before the last ranking.
SALTS = 64

_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)], _KIND[list(PIECE_ENDS)] = 1, 2
_COUNTS = "lang string, gram string, n long"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One 64-bit hash of two, element by element."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + b
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ x >> np.uint64(32)


def _hashes(strings: list[bytes]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(s) for s in strings), np.uint64, len(strings))


class Words:
    """The words of some texts: ids into a vocabulary, languages, and which word follows in the same piece."""

    def __init__(self, texts: list[bytes], langs: np.ndarray):
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)  # A-Z only
        kind = _KIND[data]
        inside = np.concatenate(([False], kind == 0, [False]))
        starts, ends = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
        piece = np.searchsorted(np.flatnonzero(kind == 2), starts)
        begins = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.n = len(starts)
        self.lang = langs[np.searchsorted(begins, starts, "right") - 1] if self.n else np.zeros(0, np.int64)
        offsets = np.zeros(self.n + 1, np.int32)
        np.cumsum(ends - starts, out=offsets[1:])
        coded = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(data[kind == 0])]).dictionary_encode()
        self.ids, self.vocabulary = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        self.follows = np.concatenate((piece[1:] == piece[:-1], [False])) if self.n else np.zeros(0, bool)

    def hashes(self, k: int, lang_hash: np.ndarray) -> np.ndarray:
        """Hash of the run of ``k`` words (with its language) at every place that has one."""
        words = _hashes(self.vocabulary.to_pylist())[self.ids]
        out = _mixed(lang_hash[self.lang], words)
        for j in range(1, k):
            out = _mixed(out[:-1], words[j:])
        return out

    def grams(self, at: np.ndarray, k: int) -> pa.Array:
        """The runs of ``k`` words at the places ``at``, joined by blanks."""
        parts = [self.vocabulary.take(pa.array(self.ids[at + j])) for j in range(k)]
        return (pc.binary_join_element_wise(*parts, b" ") if k > 1 else parts[0]).cast(pa.string())


def segments(text: bytes, most: int) -> Iterator[bytes]:
    """Parts of about ``most`` bytes or less that end with pieces; a longer piece stays whole."""
    at = 0
    while len(text) - at > most:
        window = np.frombuffer(text, np.uint8, most, at)
        cuts = np.flatnonzero(_KIND[window] == 2)
        if len(cuts):
            end = at + int(cuts[-1]) + 1
        else:
            later = [e for e in (text.find(bytes([c]), at + most) for c in PIECE_ENDS) if e >= 0]
            end = min(later) + 1 if later else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def _batches(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[Words, list[str]]]:
    """The words of about ``most`` bytes of text at a time, with the names of their languages."""
    texts: list[bytes] = []
    langs: list[str] = []
    held = 0

    def taken() -> tuple[Words, list[str]]:
        names = sorted(set(langs))
        place = {x: i for i, x in enumerate(names)}
        return Words(texts, np.array([place[x] for x in langs], np.int64)), names

    for b in by_size(batches, most=most):
        for text, lang in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("lang").to_pylist()):
            for part in segments(text, most):
                if held and held + len(part) > most:
                    yield taken()
                    texts, langs, held = [], [], 0
                texts.append(part)
                langs.append(lang)
                held += len(part) + 1
    if held:
        yield taken()


def _rows(langs: list[str], lang: np.ndarray, grams: pa.Array, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(langs).take(pa.array(lang)) if langs else pa.array([], pa.string()), grams, pa.array(n.astype(np.int64))], ["lang", "gram", "n"])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(lang, gram, f) of every word; the row with an empty gram holds the number of all words of the language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, langs in _batches(batches, batch_bytes):
            size = max(1, len(words.vocabulary))
            codes, n = np.unique(words.lang * size + words.ids, return_counts=True)
            yield _rows(langs, codes // size, words.vocabulary.take(pa.array(codes % size)).cast(pa.string()), n)
            all_words = np.bincount(words.lang, minlength=len(langs))
            yield _rows(langs, np.arange(len(langs)), pa.array([""] * len(langs)), all_words)

    return in_batches(_texts(docs), run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("f"))


def bit_table(grams: DataFrame, k: int, max_bits: int = MAX_BITS) -> tuple[Broadcast, int]:
    """The hashes of ``grams`` (lang, gram of k words) as a broadcast table of 2**bits bits, and bits."""
    bits = min(max_bits, max(16, math.ceil(math.log2(BITS_EACH * max(1, grams.count())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [x.split(b" ") for x in b.column("gram").cast(pa.binary()).to_pylist()]
            out = _hashes(b.column("lang").cast(pa.binary()).to_pylist())
            for j in range(k):
                out = _mixed(out, _hashes([p[j] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array((out >> np.uint64(64 - bits)).astype(np.int64))], ["bit"])

    # Spark numbers the bits of a bucket of 32,768 from 1
    set_bits = in_batches(grams.select("lang", "gram"), run, "bit long").select((F.col("bit") + 1).alias("bit"))
    buckets = set_bits.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = bytearray((1 << bits) // 8)
    for r in buckets.toLocalIterator():  # 2**bits / 32,768 buckets at most
        at = (r["bucket"] - 1) * 4096
        table[at : at + 4096] = r["bits"][: len(table) - at]
    return grams.sparkSession.sparkContext.broadcast(bytes(table)), bits


def tallies(words: Words, at: np.ndarray, k: int, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of runs of ``k`` words and how often each run stands at the places ``at``, in one or two parts that may share runs."""
    _, first, group, n = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)
    head = at[first][group]  # the place whose run stands for this one, if all words are the same
    same = words.lang[at] == words.lang[head]
    for j in range(k):
        same &= words.ids[at + j] == words.ids[head + j]
    yield at[first], np.bincount(group[same], minlength=len(n))
    odd = at[~same]  # runs that only share a hash with another
    if len(odd):
        yield odd, np.ones(len(odd), np.int64)


def level_counts(docs: DataFrame, below: DataFrame, k: int, batch_bytes: int = BATCH_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, gram, f) of the runs of ``k`` words both of whose runs of k - 1 words may be among ``below``."""
    table, bits = bit_table(below, k - 1, max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(table.value, np.uint8)
        for words, langs in _batches(batches, batch_bytes):
            if words.n < k:
                continue
            own = words.hashes(k - 1, _hashes([x.encode() for x in langs]))
            bit = (own >> np.uint64(64 - bits)).astype(np.int64)
            frequent = (known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            whole = frequent[:-1] & frequent[1:]
            for j in range(k - 1):
                whole &= words.follows[j : j + len(whole)]
            at = np.flatnonzero(whole)
            for first, n in tallies(words, at, k, _mixed(own[at], own[at + 1])):
                yield _rows(langs, words.lang[first], words.grams(first, k), n)

    return in_batches(_texts(docs), run, _COUNTS).groupBy("lang", "gram").agg(F.sum("n").alias("f"))


def levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, batch_bytes: int = BATCH_BYTES, max_bits: int = MAX_BITS) -> tuple[DataFrame, list[DataFrame]]:
    """(lang, n) with the words of each language, and for k = 1 to ``longest`` the table (lang, gram, f) of runs found ``least`` times or more."""
    kept = stored(word_counts(docs, batch_bytes).where((F.col("f") >= least) | (F.col("gram") == "")), "level-1")
    totals = stored(kept.where("gram = ''").select("lang", F.col("f").alias("n")), "words-by-lang")
    out = [kept.where("gram != ''")]
    for k in range(2, longest + 1):
        out.append(stored(level_counts(docs, out[-1], k, batch_bytes, max_bits).where(F.col("f") >= least), f"level-{k}"))
    return totals, out


def _part(words: Column, begin: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, begin, n), " ")


def _union(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, first: int = FIRST, cover: int = COVER, batch_bytes: int = BATCH_BYTES, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``first`` phrases by their lowest-scoring cut.

    a = f(phrase), l and r = f of the parts of the cut, n = words of the language, score =
    floor(1000 a n / (l r)). Ties of cuts go to the shortest first part. A phrase goes if its
    words lie inside a longer one (kept or not) with ``cover`` per cent of its count.
    """
    totals, tables = levels(docs, longest, least, batch_bytes, max_bits)
    every = _union(tables)
    if longest < 2:
        raise ValueError("phrases have two words at least")
    phrases = _union([t.withColumn("k", F.lit(k)) for k, t in enumerate(tables, 1) if k > 1]).withColumn("w", F.split("gram", " "))

    longer = phrases.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("begin", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inner = longer.select("lang", _part(F.col("w"), F.col("begin"), F.col("size")).alias("gram"), "f").groupBy("lang", "gram").agg(F.max("f").alias("within"))
    kept = phrases.join(inner, ["lang", "gram"], "left").where(F.col("within").isNull() | (100 * F.col("within") < cover * F.col("f")))

    cuts = kept.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("lang", "gram", F.col("f").alias("a"), "cut", _part(F.col("w"), F.lit(1), F.col("cut")).alias("head"), _part(F.col("w"), F.col("cut") + 1, F.col("k") - F.col("cut")).alias("tail"))
    heads = every.select("lang", F.col("gram").alias("head"), F.col("f").alias("l"))
    tails = every.select("lang", F.col("gram").alias("tail"), F.col("f").alias("r"))
    both = cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"]).join(totals, "lang")
    wide = {c: F.col(c).cast("decimal(38,0)") for c in ("a", "n", "l", "r")}
    up, down = F.lit(1000).cast("decimal(38,0)") * wide["a"] * wide["n"], wide["l"] * wide["r"]
    scored = both.withColumn("up", up.cast("decimal(38,0)")).withColumn("down", down.cast("decimal(38,0)")).withColumn("score", F.expr("up div down"))
    best = scored.groupBy("lang", "gram").agg(F.min(F.struct("score", "cut", "a", "l", "r", "n")).alias("best")).select("lang", "gram", "best.*")

    salted = _first(best.withColumn("salt", F.pmod(F.xxhash64("gram"), F.lit(SALTS))), ["lang", "salt"], first)
    return _first(salted, ["lang"], first).select("lang", F.col("rank").cast("long").alias("rank"), F.col("gram").alias("phrase"), "a", "l", "r", "n", "score")


def _first(rows: DataFrame, groups: list[str], n: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.col("score").desc(), F.col("a").desc(), F.col("gram"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
