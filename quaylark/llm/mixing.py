"""Mixing sources to target weights by cube-method balanced sampling.

Targets: sources by code point (null last) take the weights in turn and share all words by
them; a target stops at ``MOST`` times its source's words, and what is cut off goes to the
others by weight until none is above. A document of a source with rate r = target / words
is taken floor(r) times, and once more with probability p = r - floor(r).

The last copies are drawn by the cube method. All open units of a source start at p; a move
goes along a vector of the null space of two constraints, the words and the number of
documents taken, until a unit reaches 0 or 1, so both totals stay as they are. In the vector
the largest open unit moves against all others, which pay a little each; large documents are
thus settled while many small ones can still balance them, and what stays open is small.
Units are dealt by hash into blocks of about ``BLOCK``; a block leaves two open units at
most, and these meet again in fewer blocks, until a source fits into one. There the flight
ends with ``LANDING`` open units, and the landing takes the choice among them that is nearest
to their expected words: the last few units are thus settled by nearness, not by chance, and
a source misses its target by a few words where it has more than a handful of documents.

Scale: one pass over the texts (their words are counted in the JVM), one shuffle of narrow
rows a level, each level with 2 / ``BLOCK`` of the units before it. A source with most rows
is many blocks. All draws come from hashes and the block's own seed, so reruns agree.

Edge cases: a null or empty text has size 0 (it is drawn like others and adds nothing); rows
without doc_id or source are units like others, null being the last source; equal rows are
numbered copies of one unit, so thousands of them lie in many blocks; an empty table, or one
without words, has targets 0; extra columns, whatever their names, are ignored by ``takes``
and kept by ``mixed``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored
from .prefixsums import running_sums

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A source, and so a document, is taken this many times at most.
MOST = 3
#: Units of a block.
BLOCK = 1000
#: Open units of a source that the landing settles, over all their choices.
LANDING = 12
#: Up to this many sources their table is broadcast; beyond, it is joined.
SMALL = 10_000
#: Copies of a row listed by one row when they are numbered.
_RUN = 4096
#: A probability this near to 0 or 1 counts as that.
_NEAR = 1e-9


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _few(table: DataFrame) -> DataFrame:
    """A table of a row a source, marked for broadcast if its checked size allows."""
    return F.broadcast(table) if table.count() <= SMALL else table


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, sid, source_size, target) from (source, source_size), a row a source."""
    ranked = running_sums(sizes.withColumn("sid", F.lit(1).cast("long")), [F.col("source").isNull(), "source"], ["sid"])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = stored(ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * most), "sources")
    total, shared = rows.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, n_capped = (total / shared if shared else 0.0), -1
    while True:  # the level only rises, so the capped sources only grow in number
        above = F.col("most") < F.col("weight") * level
        capped, free, n = rows.agg(F.coalesce(F.sum(F.when(above, F.col("most"))), F.lit(0)), F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)), F.count(F.when(above, 1))).first()
        if n == n_capped or not free:
            break
        level, n_capped = (total - capped) / free, n
    return rows.select("source", "sid", "source_size", F.least(F.col("most").cast("double"), F.col("weight") * level).alias("target"))


def _vector(q: np.ndarray, s: np.ndarray) -> np.ndarray | None:
    """How much each open unit moves when the first moves by one; None if both totals cannot hold.

    The others pay in proportion to q (1 - q) and to a line in their size, fitted so that the
    numbers and the sizes add up to zero.
    """
    w, rest = q[1:] * (1 - q[1:]), s[1:]
    w0, w1, w2 = w.sum(), (w * rest).sum(), (w * rest * rest).sum()
    det = w0 * w2 - w1 * w1
    if det > 1e-9 * w0 * w2:
        a, b = (w2 - w1 * s[0]) / det, (w0 * s[0] - w1) / det
    elif len(rest) and rest[0] == s[0] and rest[-1] == s[0]:
        a, b = 1 / w0, 0.0  # all alike in size: one total is the other
    else:
        return None
    return np.concatenate(([1.0], -(a + b * rest) * w))


def flight(p: np.ndarray, size: np.ndarray, rng: np.random.Generator, leave: int = 2) -> np.ndarray:
    """Move the probabilities ``p`` of units in descending order of ``size`` to 0 or 1, until ``leave`` (or two, if that is more) are open at most."""
    p = np.where(p < _NEAR, 0.0, np.where(p > 1 - _NEAR, 1.0, p))
    s = size / max(1.0, float(size.max(initial=0)))
    at, aside = np.flatnonzero((p > 0) & (p < 1)), 0
    while len(at) and len(at) + aside > leave:
        q = p[at]
        u = _vector(q, s[at])
        if u is None:
            aside += 1  # it cannot be balanced against one unit, or units all alike
            at = at[1:]
            continue
        moves = np.abs(u) > 1e-14
        v, x = u[moves], q[moves]
        up = np.min(np.where(v > 0, 1 - x, x) / np.abs(v))
        down = np.min(np.where(v > 0, x, 1 - x) / np.abs(v))
        q = q + u * (up if rng.random() * (up + down) < down else -down)
        p[at] = np.where(q < _NEAR, 0.0, np.where(q > 1 - _NEAR, 1.0, q))
        at = at[(p[at] > 0) & (p[at] < 1)]
    return p


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Settle the last open units (``LANDING`` at most): of all choices the one nearest to their expected words, then to their expected number."""
    at = np.flatnonzero((p > 0) & (p < 1))
    choices = np.arange(1 << len(at))[:, None] >> np.arange(len(at)) & 1
    words, number = np.abs(choices @ size[at] - p[at] @ size[at]), np.abs(choices.sum(axis=1) - p[at].sum())
    p = p.copy()
    p[at] = choices[np.lexsort((number, np.round(words, 6)))[0]]
    return p


_UNIT = "sid long, doc_id {0}, size long, copy long, p double"


def _settled(units: DataFrame, level: int, block: int, seed: int) -> DataFrame:
    """One level: the open units of each source dealt into blocks, each block moved as far as it goes."""
    per = units.groupBy("sid").agg(F.count("*").alias("n")).select("sid", F.ceil(F.col("n") / block).cast("long").alias("blocks"))
    dealt = units.join(_few(stored(per, "blocks")), "sid")
    dealt = dealt.select(*units.columns, "blocks", F.pmod(F.xxhash64(F.lit(seed + level), "doc_id", "size", "copy"), "blocks").alias("block"))
    ids = units.schema["doc_id"].dataType.simpleString()

    def settle(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("size", "descending"), ("doc_id", "ascending"), ("copy", "ascending")])
        last, number, sid = rows["blocks"][0].as_py() == 1, rows["block"][0].as_py(), rows["sid"][0].as_py()
        rng = np.random.default_rng([seed, level, sid, number])
        size = rows["size"].to_numpy().astype(float)
        p = flight(rows["p"].to_numpy(), size, rng, LANDING if last else 2)
        p = landing(p, size) if last else p
        return pa.table({c: rows[c] for c in ("sid", "doc_id", "size", "copy")} | {"p": pa.array(p)})

    return stored(dealt.groupBy("sid", "block").applyInArrow(settle, _UNIT.format(ids)), "mix-level")


def takes(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK, seed: int = 2026, size: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken), a row for each row of ``docs`` (doc_id, source, text).

    ``copies`` is how often the mix takes the row, ``taken`` the words that makes. ``size``
    replaces the number of words by another count (a long over the columns of ``docs``).
    """
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), (n_words(F.col("text")) if size is None else F.coalesce(size.cast("long"), F.lit(0).cast("long"))).alias("size"))
    alike = stored(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    aims = targets(alike.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    near = F.abs(rate - F.round(rate)) < _NEAR
    aims = _few(stored(aims.withColumn("base", F.when(near, F.round(rate)).otherwise(F.floor(rate)).cast("long")).withColumn("p", F.when(near, 0.0).otherwise(rate - F.floor(rate))), "aims"))
    runs = alike.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / _RUN))))
    copies = runs.withColumn("copy", F.explode(F.sequence(F.col("run") * _RUN, F.least(F.col("n"), (F.col("run") + 1) * _RUN) - 1)))
    units = copies.join(aims, copies["source"].eqNullSafe(aims["source"])).select("sid", "doc_id", "size", "copy", "p")
    now, done, level = units, [units.where("p = 0")], 0
    while not (now := now.where("p > 0 AND p < 1")).isEmpty():
        now = _settled(now, level, block, seed)
        done.append(now.where("p IN (0, 1)"))
        level += 1
    all_units = done[0]
    for d in done[1:]:
        all_units = all_units.unionByName(d)
    out = all_units.join(aims.drop("p"), "sid").withColumn("copies", F.col("base") + F.col("p").cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, taken: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as ``taken`` (of ``takes`` with words as sizes) says; all columns stay.

    Rows alike in doc_id, source and number of words share their copies: each gets the whole
    part of the mean, and one of them the rest.
    """
    keys = ["doc_id", "source", "size"]
    own = {k: free_name(docs, f"_{k}") for k in (*keys, "times", "rest")}
    per = taken.groupBy(*keys).agg(F.sum("copies").alias("c"), F.count("*").alias("n"))
    per = per.select(*[F.col(k).alias(own[k]) for k in keys], F.expr("c div n").alias(own["times"]), F.expr("c % n").alias(own["rest"])).where("c > 0")
    named = docs.withColumn(own["size"], n_words(F.col("text")))
    match = (F.col("d.doc_id").eqNullSafe(F.col(f"t.{own['doc_id']}"))) & (F.col("d.source").eqNullSafe(F.col(f"t.{own['source']}"))) & (F.col(f"d.{own['size']}") == F.col(f"t.{own['size']}"))

    def repeated(rows: DataFrame, times: str) -> DataFrame:
        both = rows.alias("d").join(per.where(F.col(times) > 0).alias("t"), match)
        return both.select(*[F.col(f"d.{c}") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), F.col(f"t.{times}"))).alias(own["times"])).select(*docs.columns)

    return repeated(named, own["times"]).unionByName(repeated(named.dropDuplicates(["doc_id", "source", own["size"]]), own["rest"]))
