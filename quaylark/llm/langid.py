"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1 of ``DIMENSIONS`` places, drawn from
its code point. A letter n-gram is bound by multiplying the vectors of its letters,
each permuted by its place; a text is the bundle (sum) of its n-grams, a language
prototype the bundle of its texts. A text gets the language whose prototype has the
greatest cosine with it, after what all prototypes share is taken away.

Edge cases: texts that are null or have no letter get ``und`` and score 0; with no
labelled text every text gets ``und``; equal cosines go to the language that sorts
first; null labels teach nothing; repeated rows give one row each; the filter keeps all
rows where nothing was learnt.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, small_batches, texts_of

DIMENSIONS, NGRAM, SEED = 1024, 3, 11
#: Bound vectors of n-grams that a task keeps; n-grams of one text that are bundled at once.
BOUND_KEPT, STEP = 16_384, 1024
UNKNOWN = "und"
#: From this number of distinct n-grams on, a text must reach this cosine with a prototype to be recognised.
LEAST_GRAMS, LEAST_COSINE = 30, 0.2
_BITS = 21


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


@lru_cache(maxsize=1 << 12)
def letter_vector(code: int) -> np.ndarray:
    return (np.random.default_rng((SEED, code)).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1).astype(np.int8)


def bound(gram: int) -> np.ndarray:
    """Vector of an n-gram: the letters' vectors, permuted by place, multiplied."""
    out = np.ones(DIMENSIONS, np.int8)
    for place in range(NGRAM):
        out *= np.roll(letter_vector((gram >> (_BITS * place)) & ((1 << _BITS) - 1)), place)
    return out


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct letter n-grams of a text with their counts; runs of other characters are one space."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letters = letter_table()[codes]
    if not letters.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.where(letters, codes, 32).astype(np.int64)
    keep = letters.copy()
    keep[1:] |= letters[:-1]
    codes = codes[keep]
    codes = np.concatenate([[32], codes, [32] if codes[-1] != 32 else []]).astype(np.int64)
    grams_ = sum(codes[i : len(codes) - NGRAM + 1 + i] << (_BITS * i) for i in range(NGRAM))
    return np.unique(grams_, return_counts=True)


class Binder:
    """Bundles n-grams into text vectors; keeps the bound vectors of up to ``BOUND_KEPT`` of those seen.

    It lives as long as a task, so that no later stage in the same worker carries its vectors.
    """

    def __init__(self) -> None:
        self.row: dict[int, int] = {}
        self.rows = np.zeros((min(1024, BOUND_KEPT), DIMENSIONS), np.int8)

    def bundle(self, found: np.ndarray, counts: np.ndarray) -> np.ndarray:
        total = np.zeros(DIMENSIONS, np.float32)
        step = min(STEP, BOUND_KEPT)
        for at in range(0, len(found), step):
            total += counts[at : at + step].astype(np.float32) @ self._bound(found[at : at + step].tolist()).astype(np.float32)
        return total

    def _bound(self, keys: list[int]) -> np.ndarray:
        """Bound vectors of at most ``BOUND_KEPT`` distinct n-grams."""
        new = [g for g in keys if g not in self.row]
        if len(self.row) + len(new) > BOUND_KEPT:
            self.row, new = {}, keys
        while len(self.rows) < len(self.row) + len(new):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        for g in new:
            at = self.row[g] = len(self.row)
            self.rows[at] = bound(g)
        return self.rows[np.fromiter(map(self.row.__getitem__, keys), np.int64, len(keys))]


def learn(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Prototype of each language, from all rows with a label; every text weighs the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        binder = Binder()
        for b in slices(batches):
            for text, lang in zip(texts_of(b), b.column("lang").to_pylist()):
                vector = binder.bundle(*grams(text))
                if (norm := float(np.linalg.norm(vector))) > 0:
                    sums[lang] = sums.get(lang, 0) + vector / norm
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS)), pa.array(np.asarray(total, np.float64))], ["lang", "place", "value"])

    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    sums = in_batches(rows, run, "lang string, place long, value double").groupBy("lang", "place").agg(F.round(F.sum("value"), 3).alias("value"))
    out: dict[str, np.ndarray] = {}
    for r in sums.collect():  # DIMENSIONS numbers a language
        out.setdefault(r["lang"], np.zeros(DIMENSIONS))[r["place"]] = r["value"]
    return {k: out[k] / max(np.linalg.norm(out[k]), 1e-12) for k in sorted(out)}


class Profiles:
    """Language prototypes without what they share."""

    def __init__(self, prototypes: dict[str, np.ndarray]):
        self.names = [*prototypes]
        self.whole = matrix = np.array([prototypes[k] for k in self.names], np.float32).reshape(len(self.names), DIMENSIONS)
        self.shared = matrix.mean(axis=0) if len(self.names) > 1 else np.zeros(DIMENSIONS, np.float32)
        self.square = max(float(self.shared @ self.shared), 1e-12)
        apart = matrix - self.shared
        self.apart = apart / np.maximum(np.linalg.norm(apart, axis=1, keepdims=True), 1e-12)

    def nearest(self, text: str, binder: Binder | None = None) -> tuple[str, float]:
        """Language of the nearest prototype, and half of 1 + its cosine; (und, 0) without a letter."""
        found, counts = grams(text)
        if not len(found) or not self.names:
            return UNKNOWN, 0.0
        vector = (binder or Binder()).bundle(found, counts)
        vector = vector - self.shared * (float(vector @ self.shared) / self.square)
        cosines = self.apart @ vector / max(float(np.linalg.norm(vector)), 1e-12)
        best = int(np.argmax(cosines))
        return self.names[best], round(min(1.0, max(0.0, (1 + float(cosines[best])) / 2)), 6)

    def recognises(self, text: str, binder: Binder | None = None) -> bool:
        """Whether a text has letters and, from ``LEAST_GRAMS`` distinct n-grams on, is near any whole prototype.

        Shorter texts say too little: a letter is enough. The limit lies between letters at
        random (cosines up to 0.19) and texts of the languages learnt (0.24 and more).
        """
        found, counts = grams(text)
        if len(found) < LEAST_GRAMS:
            return len(found) > 0
        vector = (binder or Binder()).bundle(found, counts)
        return float((self.whole @ vector).max()) >= LEAST_COSINE * float(np.linalg.norm(vector))


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(prototypes))  # a vector a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        binder = Binder()
        for b in slices(batches):
            langs, scores = zip(*(sent.value.nearest(t, binder) for t in texts_of(b)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, f"doc_id {kind}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept for the test: a quarter, by the checksum of doc_id."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, learnt from the rows that are not held out."""
    prototypes = learn(docs.where(~held_out()).select("text", "lang"))
    return predict(docs, prototypes).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def recognised(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` in a language that was learnt (see ``Profiles.recognises``); all rows where none was learnt.

    One pass without a join or shuffle: texts go to Python, decisions come back, and rows stay as they are.
    """
    prototypes = learn(docs.where(~held_out()).select("text", "lang"))
    if not prototypes:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(prototypes))
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def known(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        binder = Binder()
        for texts in columns:
            yield pa.array([sent.value.recognises(t or "", binder) for t in texts.to_pylist()], pa.bool_())

    return docs.where(known(F.col("text").cast("string")))
