"""Texts that may hold a window of some test item: a table of bits set by the windows' hashes.

The table has up to 2**``MAX_BITS`` bits (128 MB) however many items there are, ``BITS_EACH`` or
more for each window below that, and a window sets ``PLACES`` of them. A text passes if all
places of one of its windows are set, so no text with a window is lost; others pass rarely (one
window in a million at 32 bits each, more often once the table is at its bound), which costs
time and changes nothing.

Edge cases: null and wordless texts have no window; items shorter than a window count as a
window of their own size; without items nothing passes.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches

MAX_BITS, BITS_EACH, PLACES = 30, 32, 4
#: Windows of a text that are hashed at a time.
RUN = 50_000
_RANDOM = np.random.default_rng(42)
_WORD, _PLACE = (_RANDOM.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1) for n in (64, PLACES))


class Filter(NamedTuple):
    """The broadcast table of 2**bits bits and the sizes of windows that set them."""

    table: Broadcast
    bits: int
    sizes: list[int]


def hashes(words: list[bytes], size: int) -> np.ndarray:
    """A 64-bit hash for each run of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    known = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    own = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = (out ^ own[j : j + n]) * _WORD[j % len(_WORD)]
        out ^= out >> np.uint64(31)
    return out


def places(found: np.ndarray, bits: int) -> np.ndarray:
    """The bits of each hash, a row each."""
    mixed = found[:, None] * _PLACE
    return ((mixed ^ (mixed >> np.uint64(29))) * _PLACE[::-1] >> np.uint64(64 - bits)).astype(np.int64)


def build(pieces: DataFrame, window: int, max_bits: int = MAX_BITS) -> Filter:
    """The table of all windows of ``pieces`` (piece: words joined by blanks)."""
    n_words = F.size(F.split("piece", " "))
    counted = pieces.groupBy(F.least(n_words, F.lit(window)).alias("size")).agg(F.sum(F.greatest(n_words - window + 1, F.lit(1))).alias("n")).collect()  # a row a size
    sizes, n = sorted(r["size"] for r in counted), sum(r["n"] for r in counted)
    bits = min(max_bits, max(16, math.ceil(math.log2(BITS_EACH * max(1, n)))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in b.column(0).to_pylist():
                words = piece.encode("utf-8", "replace").split(b" ")
                yield pa.RecordBatch.from_arrays([pa.array(places(hashes(words, min(window, len(words))), bits).ravel())], ["bit"])

    # Spark numbers the bits of a bucket of 32,768 from 1
    ones = in_batches(pieces.select("piece"), run, "bit long").select((F.col("bit") + 1).alias("bit"))
    buckets = ones.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    table = bytearray((1 << bits) // 8)
    for r in buckets.toLocalIterator():  # 2**bits / 32,768 buckets at most
        at = (r["bucket"] - 1) * 4096
        table[at : at + 4096] = r["bits"][: len(table) - at]
    return Filter(pieces.sparkSession.sparkContext.broadcast(bytes(table)), bits, sizes)


def may_hold(texts: Iterable[list[bytes]], windows: Filter) -> list[bool]:
    """Whether each text (as words) may hold a window."""
    known = np.frombuffer(windows.table.value, np.uint8)

    def one(words: list[bytes]) -> bool:
        for size, begin in product(windows.sizes, range(0, len(words), RUN)):
            at = places(hashes(words[begin : begin + RUN + size - 1], size), windows.bits)
            if ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1).any():
                return True
        return False

    return [one(words) for words in texts]
