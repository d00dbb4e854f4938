"""Byte-pair encoding and decoding with public vocabularies.

Method: a pair occurrence index. The distinct pre-tokens of a batch are laid end
to end as one array of symbols; an index maps every mergeable pair (by its rank)
to all its positions. Active ranks are applied in ascending order, each at all
its positions at once, and only the lists of the neighbouring pairs change. A
merge creates pairs of higher rank only, so one ascending sweep gives every
pre-token the same result as merging it alone.

Texts are cut into chunks at white space; the ids of a chunk do not depend on its
neighbours, so each distinct chunk is merged once per task and its ids are then
gathered. The store of chunks is emptied before a batch when it has ``CHUNKS_KEPT``
entries or ``CHARS_KEPT`` characters, and when the task ends, which bounds memory to
these and one batch and changes no result.

Edge cases: null and empty texts have no ids; special strings of the vocabulary
inside a text become their special id; ids outside the vocabulary decode to
nothing; repeated rows and repeated doc_ids give one row each.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, in_batches, ragged_take, slices, texts_of

CHUNKS_KEPT, CHARS_KEPT = 200_000, 4_000_000

#: The split patterns that the two public vocabularies are defined with.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_SHIFT = 20
_ODD_SPACE = re.compile("[\x1c-\x1f]")
_TWO_SPACES = re.compile(r"\s\s")
_BYTE_CHUNK = re.compile(r" ?\S+|\s")


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte: itself, or the next one from U+0100 on."""
    shown = {b for b in range(256) if (33 <= b <= 126) or (161 <= b <= 255 and b != 173)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PairIndex:
    """Merges many words at once by one ascending sweep over ranks."""

    def __init__(self, merges: list[tuple[int, int, int]]):
        self.pairs = merges
        codes = np.array([(a << _SHIFT) | b for a, b, _ in merges], np.int64)
        self.codes, self.ranks = np.unique(codes, return_index=True)

    def rank_of(self, codes: np.ndarray) -> np.ndarray:
        """Rank of each pair; -1 where the vocabulary has no such merge."""
        at = np.searchsorted(self.codes, codes)
        at[at == len(self.codes)] = 0
        return np.where(self.codes[at] == codes, self.ranks[at], -1)

    def _enter(self, index: dict[int, list[np.ndarray]], active: list[int], codes: np.ndarray, places: np.ndarray) -> None:
        """Add the places of the pairs that merge to the index."""
        ranks = self.rank_of(codes)
        keep = ranks >= 0
        ranks, places = ranks[keep], places[keep]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, places = ranks[order], places[order]
        cuts = (np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist()
        for start, end in zip([0, *cuts], [*cuts, len(ranks)]):
            r = int(ranks[start])
            if r in index:
                index[r].append(places[start:end])
            else:
                index[r] = [places[start:end]]
                heapq.heappush(active, r)

    def merge(self, sym: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words whose symbols lie end to end in ``sym``; and how many each word has."""
        n = len(sym)
        sym = np.append(sym, -1)  # what lies after and before every word
        after = np.arange(1, n + 2)
        before = np.arange(-1, n)
        ends = np.cumsum(sizes)
        after[ends - 1] = n
        before[ends - sizes] = n
        inner = np.flatnonzero(after[:n] < n)
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []
        self._enter(index, active, (sym[inner] << _SHIFT) | sym[inner + 1], inner)
        while active:
            r = heapq.heappop(active)
            a, b, made = self.pairs[r]
            found = index.pop(r)
            p = found[0] if len(found) == 1 else np.unique(np.concatenate(found))
            q = after[p]
            live = (sym[p] == a) & (sym[q] == b)
            if a == b and live.any():
                live &= self._every_other(p, q, live)
            p, q = p[live], q[live]
            if not len(p):
                continue
            sym[p] = made
            sym[q] = -1
            right = after[q]
            after[p] = right
            before[right] = p
            left = before[p]
            lefts, rights = sym[left], sym[right]
            has_left, has_right = lefts >= 0, rights >= 0
            codes = np.concatenate([(lefts[has_left] << _SHIFT) | made, (made << _SHIFT) | rights[has_right]])
            if len(codes):
                self._enter(index, active, codes, np.concatenate([left[has_left], p[has_right]]))
        kept = sym[:n] >= 0
        total = np.concatenate([[0], np.cumsum(kept)])
        return sym[:n][kept], total[ends] - total[ends - sizes]

    @staticmethod
    def _every_other(p: np.ndarray, q: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Of places of one symbol twice that overlap, take the first, third, ... of each run."""
        joined = np.zeros(len(p), bool)
        joined[1:] = (q[:-1] == p[1:]) & live[:-1]
        at = np.arange(len(p))
        first = np.maximum.accumulate(np.where(joined, 0, at))
        return (at - first) % 2 == 0


class Places(dict):
    """Place of each chunk in a store; a chunk that is not stored yet gets the next place and is listed in ``new``."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, chunk: str) -> int:
        place = self[chunk] = len(self)
        self.new.append(chunk)
        return place


class Codec:
    """A public byte-pair vocabulary: cutting, merging, ids of whole texts, and back."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.by_words = bool(suffix)
        self.pattern = regex.compile(WORD_PATTERN if self.by_words else BYTE_PATTERN)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: No chunk of ordinary text holds a line break beside other characters.
        self.special_chunk = {f"\n{t}\n": i for t, i in self.special.items()}
        self.special_cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.index = PairIndex([(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs])
        letters = byte_alphabet()
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        value = {c: b for b, c in enumerate(letters)}
        size = max(max(vocab.values()), *self.special.values()) + 1
        raw = [b""] * size
        for token, i in vocab.items():
            ends = self.by_words and token.endswith(suffix)
            body = token[: -len(suffix)] if ends else token
            raw[i] = bytes(value[c] for c in body) + b" " * ends
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.token_bytes = raw
        self.byte_sizes = np.fromiter(map(len, raw), np.int64, size)
        self.byte_starts = np.cumsum(self.byte_sizes) - self.byte_sizes
        self.flat_bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.chunks_kept, self.chars_kept = CHUNKS_KEPT, CHARS_KEPT
        self.forget()

    def forget(self) -> None:
        """Empty the store of chunks."""
        self.seen = Places()
        self.chars = 0
        self.flat_ids = np.zeros(0, np.int32)
        self.sizes = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    # --- cutting -----------------------------------------------------------

    def normal(self, text: str) -> str:
        """What the vocabulary sees of a text: lower case in composed form for word vocabularies."""
        if not self.by_words:
            return text
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """Pieces of a normal text whose ids do not depend on what surrounds them."""
        if _ODD_SPACE.search(text):
            return self.pattern.findall(text)
        if self.by_words:
            return text.split()
        if _TWO_SPACES.search(text):
            return self.pattern.findall(text)
        return _BYTE_CHUNK.findall(text)

    def cut(self, text: str) -> list[str]:
        """Chunks of a whole text; special strings are chunks of their own."""
        if "<|" in text:
            parts = self.special_cut.split(text)
            return [c for i, p in enumerate(parts) for c in ([f"\n{p}\n"] if i % 2 else self.chunks(self.normal(p)))]
        return self.chunks(self.normal(text))

    def pretokens(self, chunk: str) -> list[str]:
        letters = chunk if self.by_words else chunk.removeprefix(" ")
        if letters.isascii() and letters.isalpha():  # one pre-token of either pattern
            return [chunk]
        return self.pattern.findall(chunk)

    # --- encoding ----------------------------------------------------------

    def merge_pretokens(self, pretokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct pre-tokens end to end, and how many each has."""
        raw = [p.encode() for p in pretokens]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        values = np.frombuffer(b"".join(raw), np.uint8)
        sym = self.first[values]
        ends = np.cumsum(sizes) - 1
        sym[ends] = self.final[values[ends]]
        return self.index.merge(sym, sizes)

    def learn(self, new: list[str]) -> None:
        """Store the ids of new chunks, whose places follow those stored."""
        cuts = [[c] if c in self.special_chunk else self.pretokens(c) for c in new]
        at: dict[str, int] = {}
        place = np.fromiter((at.setdefault(p, len(at)) for p in chain.from_iterable(cuts)), np.int64)
        words = list(at)
        plain = [w for w in words if w not in self.special_chunk]
        ids, counts = self.merge_pretokens(plain)
        if len(plain) < len(words):
            parts = iter(np.split(ids, np.cumsum(counts)[:-1]))
            lists = [np.array([self.special_chunk[w]]) if w in self.special_chunk else next(parts) for w in words]
            ids, counts = np.concatenate(lists), np.fromiter(map(len, lists), np.int64, len(lists))
        starts = np.cumsum(counts) - counts
        flat = ragged_take(ids, starts[place], counts[place]).astype(np.int32)
        total = np.concatenate([[0], np.cumsum(counts[place])])
        edges = total[np.concatenate([[0], np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))])]
        self.starts = np.concatenate([self.starts, len(self.flat_ids) + edges[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(edges)])
        self.flat_ids = np.concatenate([self.flat_ids, flat])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and how many each text has."""
        if len(self.seen) >= self.chunks_kept or self.chars >= self.chars_kept:
            self.forget()
        cuts = [self.cut(t) for t in texts]
        at = np.fromiter(map(self.seen.__getitem__, chain.from_iterable(cuts)), np.int64)
        if self.seen.new:
            self.learn(self.seen.new)
            self.chars += sum(map(len, self.seen.new))
            self.seen.new = []
        sizes = self.sizes[at]
        ends = np.cumsum(np.fromiter(map(len, cuts), np.int64, len(cuts)))
        total = np.concatenate([[0], np.cumsum(sizes)])
        bounds = total[np.concatenate([[0], ends])]
        return ragged_take(self.flat_ids, self.starts[at], sizes), np.diff(bounds)

    # --- decoding ----------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """Texts of ids given end to end; bytes that are not UTF-8 become U+FFFD."""
        known = (ids >= 0) & (ids < len(self.byte_sizes))
        if not known.all():
            total, ends = np.concatenate([[0], np.cumsum(known)]), np.cumsum(counts)
            ids, counts = ids[known], total[ends] - total[ends - counts]
        raw = ragged_take(self.flat_bytes, self.byte_starts[ids], self.byte_sizes[ids]).tobytes()
        ends = np.concatenate([[0], np.cumsum(self.byte_sizes[ids])])[np.cumsum(counts)].tolist()
        return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *ends], ends)]


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """The vocabulary at ``path``, once per Python worker."""
    return Codec(path)


@contextmanager
def task_codec(path: str, times: int = 1) -> Iterator[Codec]:
    """The vocabulary at ``path`` for one task, without chunks of other tasks before or after it; ``times`` the usual store."""
    own = codec(path)
    own.chunks_kept, own.chars_kept = times * CHUNKS_KEPT, times * CHARS_KEPT
    own.forget()
    try:
        yield own
    finally:
        own.forget()
        pa.default_memory_pool().release_unused()


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as own:
            for b in by_size(batches):
                ids, counts = own.encode(texts_of(b))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, counts)], ["doc_id", "ids"])

    return in_batches(_two(docs, id_col, text_col), run, f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids); null ids give the empty text."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for b in slices(batches):
            lists = [np.asarray([i for i in x or [] if i is not None and 0 <= i < len(own.byte_sizes)], np.int64) for x in b.column("ids").to_pylist()]
            texts = own.decode(np.concatenate(lists), np.fromiter(map(len, lists), np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return in_batches(rows.select("doc_id", "ids"), run, f"doc_id {kind}, text string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded) of every whole text, encoded and decoded in one pass over the rows."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with task_codec(path) as own:
            for b in by_size(batches):
                ids, counts = own.encode(texts_of(b))
                texts = own.decode(ids, counts)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), _lists(ids, counts), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    return in_batches(_two(docs, id_col, text_col), run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(rows: DataFrame, *kept: str) -> DataFrame:
    """Digest columns of ``round_trip`` rows, beside the columns ``kept``."""
    return rows.select(
        "doc_id",
        *kept,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _two(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
