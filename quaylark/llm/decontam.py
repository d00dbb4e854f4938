"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all test items build one automaton (over word ids, item after item). A
training text streams its words through it; the longest match that ends at each word
is tracked. Where it reaches the window length, the last words are a window of some
item and are hit. Items shorter than a window match as a whole only.

Most words of a text cannot be part of a match. Only stretches of words whose
neighbours also stand side by side in some item are streamed, which loses nothing: a
match of two words or more never spans other neighbours.

Items are cut to pieces of ``PIECE`` words that overlap by a window less one word, so that
each window lies in a piece, and equal pieces count once: the automaton knows a piece by its
SHA-256 only, and which items hold it is joined to the texts that were hit, once for each
distinct set of pieces. An automaton holds about ``BLOCK_CHARS`` characters of pieces. Larger
test sets are dealt to blocks, an automaton for each; then only texts that may hold a window by
``windowfilter`` are written to the shared folder and pass block after block, and a pass adds
its hits to those of the passes before. The other texts are neither copied nor matched.

Edge cases: null, empty and wordless texts have no words and no hits; wordless items
never occur; repeated items each count; items with a null item_id count under an
empty name; repeated rows give one row each; without items nothing is hit.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windowfilter
from .common import free_name, in_batches, slices, stored, texts_of

WINDOW = 10
#: Characters of test items that one automaton holds (about 120 MB a worker), and words of a piece of an item.
BLOCK_CHARS, PIECE = 2_000_000, 2000
#: Share of hit words above which a text goes as a whole.
COVERAGE = 0.5

#: The words of ``words_of`` in a lower-cased text, as a pattern; and in a text as it is, capitals included.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if chr(b).isalnum() and b < 128 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    """Digits, letters a-z (A-Z lower-cased) and everything beyond ASCII make words."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


class Automaton:
    """Suffix automaton of several word sequences, with the items each state belongs to."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.word: dict[bytes, int] = {}
        sequences = [(name, [self.word.setdefault(w, len(self.word) + 1) for w in words_of(text)]) for name, text in items]
        sequences = [(name, s) for name, s in sequences if s]
        self.shortest = min([window, *(len(s) for _, s in sequences)])
        for _, s in sequences:
            last = 0
            for w in s:
                last = self._extend(last, w)
        self.items: list[set[str]] = [set() for _ in self.size]
        self.whole: dict[int, dict[int, set[str]]] = {}
        for name, s in sequences:
            self._own(name, s)
        self._join_links()
        grams = {(a << 32) | b for _, s in sequences for a, b in zip(s, s[1:])}
        self.neighbours = np.array(sorted(grams), np.int64)
        self.occurring: dict[int, frozenset[str]] = {}

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            there = self.next[last][w]
            if self.size[there] == self.size[last] + 1:
                return there
            return self._split(last, w, there)
        made = self._state(self.size[last] + 1, {})
        while last >= 0 and w not in self.next[last]:
            self.next[last][w] = made
            last = self.link[last]
        if last < 0:
            self.link[made] = 0
        else:
            there = self.next[last][w]
            self.link[made] = there if self.size[there] == self.size[last] + 1 else self._split(last, w, there)
        return made

    def _state(self, size: int, follows: dict[int, int], link: int = 0) -> int:
        self.next.append(follows)
        self.size.append(size)
        self.link.append(link)
        return len(self.size) - 1

    def _split(self, last: int, w: int, there: int) -> int:
        copy = self._state(self.size[last] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = copy
        while last >= 0 and self.next[last].get(w) == there:
            self.next[last][w] = copy
            last = self.link[last]
        return copy

    def _own(self, name: str, s: list[int]) -> None:
        """Mark the states of an item's windows; of a short item, the state of its whole."""
        state = 0
        for w in s:
            state = self.next[state][w]
            if len(s) >= self.window:
                self.items[state].add(name)
        if len(s) < self.window:
            self.whole.setdefault(state, {}).setdefault(len(s), set()).add(name)

    def _join_links(self) -> None:
        """An item that holds a state's words holds those of its link: pass items up, longest first."""
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__, reverse=True):
            if self.size[state] >= self.window and self.size[self.link[state]] >= self.window:
                self.items[self.link[state]] |= self.items[state]
        self.short = [False] * len(self.size)
        for state in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            self.short[state] = state in self.whole or self.short[self.link[state]]

    def _windows(self, state: int, length: int) -> tuple[int, frozenset[str]]:
        """Words hit by what ends here, and the items that occur."""
        hit, found = 0, set()
        if length >= self.window:
            at = state
            while self.size[self.link[at]] >= self.window:
                at = self.link[at]
            hit, found = self.window, set(self.items[at])
        while state > 0 and self.short[state]:
            for size, names in self.whole.get(state, {}).items():
                if size <= length:
                    hit, found = max(hit, size), found | names
            state = self.link[state]
        return hit, frozenset(found)

    def match(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and which items occur."""
        hit = np.zeros(len(words), bool)
        found: set[str] = set()
        ids = np.fromiter(map(self.word.get, words, repeat(0)), np.int64, len(words))
        if self.shortest >= 2:
            beside = np.zeros(len(words) + 1, bool)
            i = np.flatnonzero((ids[1:] > 0) & (ids[:-1] > 0))
            if len(i) and len(self.neighbours):
                pair = (ids[i] << 32) | ids[i + 1]
                at = np.minimum(np.searchsorted(self.neighbours, pair), len(self.neighbours) - 1)
                beside[i[self.neighbours[at] == pair] + 1] = True  # word i + 1 may follow word i
            edge = np.flatnonzero(beside[1:] != beside[:-1]).reshape(-1, 2)
            runs = [(a, b + 1) for a, b in edge.tolist() if b - a + 1 >= self.shortest]
        else:
            runs = [(0, len(words))]
        for start, end in runs:
            state = length = 0
            for p, w in enumerate(ids[start:end].tolist(), start):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.size[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                if length >= self.window or length and self.short[state]:
                    n, names = self._windows(state, length)
                    if n:
                        hit[p - n + 1 : p + 1] = True
                        found |= names
        return hit, found


def spans_of(text: str, hit: np.ndarray) -> list[dict[str, int]]:
    """Stretches of hit words as code points, start included and end excluded."""
    if not hit.any():
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))).reshape(-1, 2)
    return [{"start": places[a][0], "end": places[b - 1][1]} for a, b in edge.tolist()]


SPANS = "array<struct<start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def pieces_of(items: DataFrame, id_col: str, text_col: str, window: int, piece: int = PIECE) -> DataFrame:
    """(item, piece): the words of each item, in pieces that share ``window`` - 1 words with the next one.

    An item with fewer words than a window is one piece; one of a window or more has no shorter piece.
    """
    lower = F.translate(F.coalesce(F.col(text_col).cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.regexp_extract_all(lower, F.lit(WORDS), F.lit(0))
    step = max(piece, window) - window + 1
    last = F.greatest(F.size("words") - window, F.lit(0))
    starts = F.sequence(F.lit(0), last, F.lit(step))
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), words.alias("words")).where(F.size("words") > 0)
    return rows.select("item", F.explode(F.transform(starts, lambda s: F.array_join(F.slice("words", s + 1, step + window - 1), " "))).alias("piece"))


def blocks_of(items: DataFrame, id_col: str, text_col: str, block_chars: int, window: int = WINDOW, piece: int = PIECE) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """``dealt`` over ``distinct_pieces``."""
    return dealt(distinct_pieces(items, id_col, text_col, window, piece), block_chars)


def distinct_pieces(items: DataFrame, id_col: str, text_col: str, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """Stored rows (digest, piece)."""
    pieces = pieces_of(items, id_col, text_col, window, piece).select("piece").distinct()
    return stored(pieces.select(_digest().alias("digest"), "piece"), "item-pieces")


def dealt(rows: DataFrame, block_chars: int) -> tuple[int, Iterator[list[tuple[str, str]]]]:
    """How many blocks the test items make, and the blocks of (digest, piece) on the driver, one after another.

    Each distinct piece stands once, however many items hold it, so a block is bounded by its characters.
    """
    chars = rows.agg(F.sum(F.length("piece"))).first()[0] or 0
    n = 1 + chars // block_chars
    own = (rows.where(F.pmod(F.xxhash64("piece"), F.lit(n)) == k) if n > 1 else rows for k in range(n))
    return n, ([(r["digest"], r["piece"]) for r in block.collect()] for block in own)


def _digest() -> Column:
    return F.sha2("piece", 256)


def _with_items(found: DataFrame, items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Stored rows whose ``items`` are digests of pieces, with the names of the items that hold these.

    Rows without a hit pass as they are. Texts hit by the same pieces share one set, so a
    passage that many texts hold is joined with its items once.
    """
    owners = pieces_of(items, id_col, text_col, window).select(_digest().alias("digest"), "item").distinct()
    clean, hit = found.where(F.size("items") == 0), found.where(F.size("items") > 0)
    sets = hit.select(F.col("items").alias("set")).distinct()
    named = sets.select("set", F.explode("set").alias("digest")).join(owners, "digest").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("names"))
    rows = hit.join(named, F.col("items") == F.col("set"))
    return clean.unionByName(rows.select(*[F.col("names").alias("items") if c == "items" else F.col(c) for c in found.columns]))


def _pass(rows: DataFrame, items: list[tuple[str, str]], window: int, last: bool) -> DataFrame:
    """Add the hits and pieces (as ``items``) of one block to rows (doc_id, text, hits, items); the last pass gives spans for texts."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    sent = rows.sparkSession.sparkContext.broadcast(Automaton(items, window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: dict[str, list] = {k: [] for k in ("n_words", "hits", "spans", "items")}
            for text, hits, names in zip(texts_of(b), b.column("hits").to_pylist(), b.column("items").to_pylist()):
                words = words_of(text)
                hit, found = sent.value.match(words)
                hit[hits] = True
                out["n_words"].append(len(words))
                out["hits"].append(np.flatnonzero(hit).tolist())
                out["spans"].append(spans_of(text, hit) if last else [])
                out["items"].append(sorted(found.union(names)))
            hits, names = pa.array(out["hits"], pa.list_(pa.int32())), pa.array(out["items"], pa.list_(pa.string()))
            if last:
                cols = [b.column("doc_id"), pa.array(out["n_words"], pa.int64()), hits, pa.array(out["spans"], _SPANS), names]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "hits", "spans", "items"])
            else:
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), hits, names], ["doc_id", "text", "hits", "items"])

    gives = f"doc_id {kind}, n_words long, hits array<int>, spans {SPANS}, items array<string>" if last else f"doc_id {kind}, text string, hits array<int>, items array<string>"
    return in_batches(rows, run, gives)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, n_words, hits, spans, items) of every whole text: hit words by number and as code points.

    The rows pass each block of items in turn (with several blocks, those that may hold a window).
    After each block they are written to the shared folder, so that a worker holds one automaton
    at a time; the texts go with the last.
    """
    none = F.array()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), none.cast("array<int>").alias("hits"), none.cast("array<string>").alias("items"))
    pieces = distinct_pieces(items, item_col, item_text, window)
    n, blocks = dealt(pieces, block_chars)
    rows, rest = (rows, None) if n == 1 else _sifted(rows, pieces, window)
    for k, block in enumerate(blocks, 1):
        rows = stored(_pass(rows, block, window, k == n), "items-matched")
    out = _with_items(rows, items, item_col, item_text, window)
    return out if rest is None else out.unionByName(_pass(rest, [], window, True))


def report(found: DataFrame) -> DataFrame:
    """Counts and digests of ``scan`` rows."""
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``docs`` without the hit stretches; texts with a larger share of hit words than ``coverage`` go.

    The rows pass each block of items in turn (with several blocks, those that may hold a
    window), without a join; the last pass cuts what any block hit. ``n_chars`` follows the text where the column exists.
    """
    hits = free_name(docs, "_hits")
    rows = docs.withColumn(hits, F.array().cast("array<int>"))
    pieces = distinct_pieces(items, "item_id", "text", window)
    n, blocks = dealt(pieces, block_chars)
    rows, rest = (rows, None) if n == 1 else _sifted(rows, pieces, window)
    for k, block in enumerate(blocks, 1):
        rows = _cut(rows, hits, block, window, coverage) if k == n else stored(_marked(rows, hits, block, window), "items-marked")
    rows = (rows if rest is None else rows.unionByName(rest)).drop(hits)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else rows


def _sifted(rows: DataFrame, pieces: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Rows whose text may hold a window of the pieces, stored; and the others."""
    windows = windowfilter.build(pieces, window)

    def those(wanted: bool) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in slices(batches):
                may = windowfilter.may_hold(map(words_of, texts_of(b)), windows)
                yield b.filter(pa.array([m == wanted for m in may]))

        return in_batches(rows, run, rows.schema)

    return stored(those(True), "items-candidates"), those(False)


def _marked(rows: DataFrame, hits: str, items: list[tuple[str, str]], window: int) -> DataFrame:
    """Add the hit words of one block of items to the column ``hits``."""
    sent = rows.sparkSession.sparkContext.broadcast(Automaton(items, window))
    place = rows.columns.index(hits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out = []
            for text, before in zip(texts_of(b), b.column(hits).to_pylist()):
                hit, _ = sent.value.match(words_of(text))
                hit[before] = True
                out.append(np.flatnonzero(hit).tolist())
            yield b.set_column(place, b.schema.field(place), pa.array(out, b.schema.field(place).type))

    return in_batches(rows, run, rows.schema)


def _cut(rows: DataFrame, hits: str, items: list[tuple[str, str]], window: int, coverage: float) -> DataFrame:
    """Match the last block of items and cut all hit stretches out of the texts."""
    sent = rows.sparkSession.sparkContext.broadcast(Automaton(items, window))
    place = rows.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts, kept = b.column("text").to_pylist(), []
            for i, (text, before) in enumerate(zip(texts_of(b), b.column(hits).to_pylist())):
                hit, _ = sent.value.match(words_of(text))
                hit[before] = True
                kept.append(not hit.any() or hit.mean() <= coverage)
                for s in reversed(spans_of(text, hit)):
                    texts[i] = texts[i][: s["start"]].rstrip() + " " + texts[i][s["end"] :].lstrip()
            yield b.set_column(place, b.schema.field(place), pa.array(texts, b.schema.field(place).type)).filter(pa.array(kept))

    return in_batches(rows, run, rows.schema)
