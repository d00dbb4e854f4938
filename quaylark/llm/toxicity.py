"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are its distinct words (letters, lower case) and the beginnings of
longer words. One weight for each feature is shared by all ordered thresholds: P(grade > k) = s(w.x + b - t_k) with the
logistic s and rising t_k. The expected severity is the sum of P(grade > k) over k.

The model is fitted on the driver on at most ``MAX_TRAIN`` labelled rows, drawn by a
hash of the id. Features of fewer than ``MIN_DOCS`` of these rows, or that occur about as
often in clean ones (``least_chi2``), have no weight; they are counted in Spark, and only
the ``MAX_FEATURES`` with the greatest chi-square, and the rows' shares of these, come to
the driver. ``MAX_FEATURES`` and ``MAX_MARKS`` bound the model, as ``MAX_TRAIN`` bounds its
rows: words beyond them, by rank, have no weight. Fewer than 12 labelled rows prove nothing
about any word, so every text then has the severity of the intercept. Scoring runs over all rows and whole texts.

Edge cases: null, empty and wordless texts have no features and get the severity of the
intercept, which never counts as toxic; null labels are not learnt from, nor are rows without doc_id; a repeated
doc_id is learnt from once, with its least text; labels that contradict each other both
count; without labelled rows every severity is 0; scoring gives one row for each row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, slices, stored, texts_of

MAX_TRAIN, MIN_DOCS, MAX_FEATURES = 8000, 5, 20_000
#: Words that mark severity in training: those most typical of toxic rows, at most so many.
MAX_MARKS = 200
STEMS = (4, 5, 6, 7)
#: Words whose chi-square against the grade is lower carry no weight: long texts hold many that are noise.
LEAST_CHI2 = 40.0
#: With few labelled rows a word that parts them perfectly has a chi-square of their number less one, so the limit is
#: a share of their number there, and never below the value that one word in a thousand reaches by chance.
SHARE_OF_ROWS, BY_CHANCE = 0.6, 10.83
_TABLE = bytes((b + 32 if 65 <= b <= 90 else b) if 97 <= b <= 122 or 65 <= b <= 90 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> set[bytes]:
    return set(text.encode("utf-8", "replace").translate(_TABLE).split())


def features(text: str) -> list[int]:
    """Distinct words and beginnings of longer words (``STEMS`` bytes), as unsigned 63-bit hashes."""
    words = words_of(text)
    stems = {w[:n] + b"*" for w in words for n in STEMS if len(w) > n}
    return [xxhash.xxh64_intdigest(w) >> 1 for w in words | stems]


@dataclass
class Ordinal:
    """Shared weights by word hash, and the rising thresholds; ``cut`` is the severity from which a text counts as toxic."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float

    def severities(self, rows: list[list[int]]) -> np.ndarray:
        if not len(self.thresholds):
            return np.zeros(len(rows))
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.array([h for r in rows for h in r], np.int64)
        value = np.zeros(len(flat))
        if len(self.keys) and len(flat):
            at = np.minimum(np.searchsorted(self.keys, flat), len(self.keys) - 1)
            value = np.where(self.keys[at] == flat, self.weights[at], 0.0)
        total = np.concatenate([[0.0], np.cumsum(value)])
        ends = np.cumsum(sizes)
        score = total[ends] - total[ends - sizes]
        return (1 / (1 + np.exp(-np.clip(score[:, None] - self.thresholds, -40, 40)))).sum(axis=1)


def sampled(labelled: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """At most about ``most`` labelled rows, by a hash of the id (all, where there are fewer)."""
    n = labelled.count()
    return labelled if n <= most else labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < most)


def fit(train: DataFrame, grades: int, steps: int = 300, penalty: float = 1e-4) -> Ordinal:
    """Fit on rows (text, grade 0 .. grades - 1); the caller bounds their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = pa.array([features(t) for t in texts_of(b)], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("grade"), rows], ["grade", "words"])

    rows = train.where(F.col("grade").isNotNull()).select(F.col("grade").cast("int").alias("grade"), F.col("text").cast("string").alias("text"))
    rows = stored(in_batches(rows, run, "grade int, words array<long>").withColumn("row", F.monotonically_increasing_id()), "training-rows")
    graded = rows.select("row", "grade").toArrow()  # bounded as the training rows are
    order = np.argsort(graded.column("row").to_numpy())
    number, grade = graded.column("row").to_numpy()[order], graded.column("grade").to_numpy()[order].astype(np.int64)
    if not len(grade):
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 0.5)
    each = rows.select("row", "grade", F.explode("words").alias("word"))
    seen = each.groupBy("word").agg(F.count("*").alias("seen"), F.count_if(F.col("grade") > 0).alias("marked"))
    score = association(F.col("seen"), F.col("marked"), len(grade), int((grade > 0).sum()))
    kept = seen.where((F.col("seen") >= MIN_DOCS) & (score >= least_chi2(len(grade)))).orderBy(score.desc(), "word").limit(MAX_FEATURES).select("word")
    shares = each.join(F.broadcast(kept), "word").select("row", "word").toArrow()
    owner = np.searchsorted(number, shares.column("row").to_numpy())
    keys, word = np.unique(shares.column("word").to_numpy(), return_inverse=True)
    order = np.lexsort((word, owner))  # the same sums whatever order the rows came in
    return _descend(owner[order], word[order], keys, grade, grades, steps, penalty)


def least_chi2(n: int) -> float:
    """The chi-square that a word must reach among ``n`` labelled rows."""
    return min(LEAST_CHI2, max(BY_CHANCE, SHARE_OF_ROWS * n))


def association(seen: Column, marked: Column, n: int, positive: int) -> Column:
    """Chi-square of a feature against grade > 0, from its texts and those of them that are graded."""
    expected = seen * (positive / n)
    spread = expected * (1 - positive / n) * (1 - seen / n) * (n / max(n - 1, 1))
    return F.pow(marked - expected, 2) / F.greatest(spread, F.lit(1e-9))


def _descend(owner: np.ndarray, word: np.ndarray, keys: np.ndarray, grade: np.ndarray, grades: int, steps: int, penalty: float) -> Ordinal:
    """Full gradients with a step of its own for every weight (Adagrad)."""
    n, m = len(grade), len(keys)
    over = (grade[:, None] > np.arange(grades - 1)).astype(float)
    rate = np.clip(over.mean(axis=0), 1e-4, 1 - 1e-4)
    t = np.log((1 - rate) / rate)
    w = np.zeros(m)
    # rare grades weigh as much as common ones
    share = np.bincount(grade, minlength=grades) / n
    weight = (1 / np.maximum(share, 1e-6))[grade]
    weight /= weight.sum()
    gw, gt = np.full(m, 1e-8), np.full(len(t), 1e-8)
    for _ in range(steps):
        score = np.bincount(owner, w[word], n)
        p = 1 / (1 + np.exp(-np.clip(score[:, None] - t, -40, 40)))
        error = (p - over) * weight[:, None]
        dw = np.bincount(word, error.sum(axis=1)[owner], m) + penalty * w
        dt = -error.sum(axis=0)
        gw += dw * dw
        gt += dt * dt
        w -= 0.3 * dw / np.sqrt(gw)
        t = np.maximum.accumulate(t - 0.3 * dt / np.sqrt(gt))
    keep = np.abs(w) > 1e-3
    model = Ordinal(keys[keep], w[keep], t, 0.5)
    score = np.bincount(owner, np.where(keep, w, 0.0)[word], n)
    severity = (1 / (1 + np.exp(-np.clip(score[:, None] - t, -40, 40)))).sum(axis=1)
    none = float(model.severities([[]])[0])
    model.cut = max(_best_cut(severity, grade > 0), none + 1e-5)  # a text without any sign is not toxic
    return model


def _best_cut(severity: np.ndarray, positive: np.ndarray) -> float:
    """The severity that parts the two sides of the training rows best, a missed row counted twice, in the middle of the gap."""
    order = np.argsort(severity, kind="stable")
    s, y = severity[order], positive[order]
    wrong = 2 * np.concatenate([[0], np.cumsum(y)]) + np.concatenate([np.cumsum((~y)[::-1])[::-1], [0]])
    at = np.flatnonzero(wrong == wrong.min())
    at = int(at[len(at) // 2])
    low = s[at - 1] if at else 0.0
    high = s[at] if at < len(s) else s[-1] + 1
    return float((low + high) / 2)


def grade_severity(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, severity, grade, toxic) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the training rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = np.round(sent.value.severities([features(t) for t in texts_of(b)]), 6)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values)], ["doc_id", "severity"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    toxic = F.col("severity") >= model.cut
    grade = F.when(toxic, F.greatest(F.lit(1), F.round("severity").cast("int"))).otherwise(F.lit(0))
    return in_batches(rows, run, f"doc_id {kind}, severity double").withColumns({"grade": grade, "toxic": toxic})


def severity_labels(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """(text, grade) for training: 0 clean; toxic texts 1, 2 or 3 by their number of marked words.

    The labels only say toxic or not. A word marks toxicity where toxic sample rows
    hold it in ``MIN_DOCS`` texts or more and at least 20 times as often, by share of
    texts, as clean ones (the ``MAX_MARKS`` with the greatest ratio); a toxic text with
    1, 2 or more distinct such words has grade 1, 2 or 3.
    """
    sample = sampled(labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic").distinct(), most)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    own = texts.join(F.broadcast(sample.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))  # at most ``most`` ids
    rows = stored(own.join(sample, "doc_id"), "labelled")
    distinct = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    words = rows.select("toxic", F.explode(distinct).alias("word"))
    n = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    bad = words.groupBy("word").agg(F.count_if(F.col("toxic") == 1).alias("t"), F.count_if(F.col("toxic") != 1).alias("c"))
    ratio = (F.col("t") / max(n.get(1, 0), 1)) / ((F.col("c") + 0.5) / max(n.get(0, 0), 1))
    marked = [r["word"] for r in bad.where((F.col("t") >= MIN_DOCS) & (ratio >= 20)).orderBy(ratio.desc(), "word").limit(MAX_MARKS).collect()]
    hits = F.size(F.array_intersect(distinct, F.array(*map(F.lit, marked)).cast("array<string>")))
    return rows.select("text", F.when(F.col("toxic") == 1, F.least(F.greatest(hits, F.lit(1)), F.lit(3))).otherwise(0).alias("grade"))
