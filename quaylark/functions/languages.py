"""Languages by character trigrams: counts learnt from labelled rows, log-probabilities looked up by hash.

Learning counts the hashed trigrams of all labelled texts, a partial table a task, summed in
Spark; what reaches the driver is a number for each language and each of ``CELLS`` cells. A
text is scored by adding up the rows of that table at its trigrams. Texts without three
letters, and those whose best language is not ``LEAD`` a letter ahead of the second, have no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..batches import by_size

CELLS = 1 << 15
#: Languages at most: with CELLS the bound of the model (4 MB each on the driver in learning).
MAX_LANGUAGES = 200
#: The single language reads so many characters; chunks, the least of them, and the least share.
HEAD, CHUNK, LEAST_CHUNK, SHARE = 500, 500, 80, 0.15
LEAD = 0.05


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the trigrams of letters and blanks, and their places; other characters count as one blank."""
    low = text.lower() if text.isascii() else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
    codes = np.frombuffer(low.encode("utf-32-le"), np.uint32).astype(np.uint64)
    letter = _letters(low, codes)
    codes = np.where(letter, codes, np.uint64(32))
    kept = letter | np.concatenate(([True], letter[:-1]))
    at, codes = np.flatnonzero(kept), codes[kept]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mixed = (codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA6B) + codes[2:]) * np.uint64(0xC2B2AE3D27D4EB4F)
    some = (codes[1:-1] != 32) | (codes[:-2] != 32) & (codes[2:] != 32)
    return (mixed >> np.uint64(49)).astype(np.int64)[some], at[:-2][some]


def _letters(text: str, codes: np.ndarray) -> np.ndarray:
    ascii_ = (codes >= 97) & (codes <= 122)
    if text.isascii():
        return ascii_
    wide = np.flatnonzero(codes > 127)
    ascii_[wide] = [text[i].isalpha() for i in wide]
    return ascii_


def learn(labelled: DataFrame, text: str, lang: str) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities as an array of CELLS rows and a column each) from all rows with a language."""
    rows = labelled.where(F.col(lang).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in by_size(batches):
            for name, t in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if name not in counts and len(counts) == MAX_LANGUAGES:
                    raise ValueError(f"more than {MAX_LANGUAGES} languages")
                own = counts.setdefault(name, np.zeros(CELLS, np.int64))
                own += np.bincount(trigrams(t)[0], minlength=CELLS)
        for name, own in counts.items():
            cells = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(cells), pa.string()), pa.array(cells.astype(np.int32)), pa.array(own[cells])], ["lang", "cell", "n"])

    total = rows.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = total.toLocalIterator()  # CELLS rows a language at most
    tables: dict[str, np.ndarray] = {}
    for r in found:
        tables.setdefault(r["lang"], np.zeros(CELLS))[r["cell"]] = r["n"]
    names = sorted(tables)
    if not names:
        return [], np.zeros((CELLS, 0), np.float32)
    counts = np.stack([tables[n] for n in names], axis=1) + 0.5
    return names, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _best(sums: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Index of the best language of each row, -1 where it has no clear lead."""
    if sums.shape[1] == 0:
        return np.full(len(sums), -1)
    best = sums.argmax(axis=1)
    if sums.shape[1] == 1:
        return np.where(n > 0, best, -1)
    top = np.partition(sums, -2, axis=1)
    return np.where((n > 0) & (top[:, -1] - top[:, -2] >= LEAD * n), best, -1)


def chunk_languages(text: str, table: np.ndarray, chunk: int = CHUNK, least: int = LEAST_CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """Language (index or -1) and length of each chunk of ``chunk`` characters with ``least`` or more."""
    n = max(1, -(-len(text) // chunk))
    cells, at = trigrams(text)
    where = at // chunk
    sums = np.stack([np.bincount(where, table[cells, j], n) for j in range(table.shape[1])], axis=1) if table.shape[1] else np.zeros((n, 0))
    sizes = np.minimum(chunk, len(text) - chunk * np.arange(n))
    kept = sizes >= least
    return _best(sums, np.bincount(where, minlength=n))[kept], sizes[kept]


def with_languages(df: DataFrame, text: str, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """``df`` with ``language`` (of the first HEAD characters, or null) and ``languages`` (those of SHARE or more of the chunks' characters, largest first).

    A text without a chunk of LEAST_CHUNK characters is one chunk. Null and empty texts have neither.
    """
    names, table = model
    own = df.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_size(batches, text):
            one, many = [], []
            for t in b.column(text).to_pylist():
                t = t or ""
                head = chunk_languages(t[:HEAD], own.value, HEAD, 0)[0]
                one.append(names[head[0]] if len(head) and head[0] >= 0 else None)
                got, sizes = chunk_languages(t, own.value)
                if not len(got):
                    got, sizes = chunk_languages(t, own.value, max(1, len(t)), 0)
                share = np.bincount(got[got >= 0], sizes[got >= 0], len(names)) / max(1, sizes.sum()) if names else np.zeros(0)
                many.append([names[i] for i in np.argsort(-share, kind="stable") if share[i] >= SHARE])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(one, pa.string()), pa.array(many, pa.list_(pa.string()))], [*b.schema.names, "language", "languages"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{kinds}, language string, languages array<string>")
