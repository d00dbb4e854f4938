"""Terms of a dictionary in texts by an Aho-Corasick automaton: one pass a text, whatever the number of terms.

A term counts where no word character stands right before or after it ("Java" is not in
"JavaScript", "C++" is in "C++, Go"). Terms match in any case unless they ask for their
capitals. The automaton is built from at most ``BLOCK`` terms, which are sent to the tasks;
a larger dictionary goes in several blocks, a pass for each, and their findings are joined.

Edge cases: null texts have no terms; empty terms are left out; several terms may share a
slug, and equal terms may differ in it; tags of HTML count as blanks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Terms of an automaton (about 20 MB of them a worker).
BLOCK = 100_000
_TAG = re.compile(r"<[^>]+>")
_WORD = re.compile(r"\w")


def lowered(text: str) -> str:
    """Lower case, a character for a character, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def automaton(terms: list[tuple[str, str, bool]]) -> ahocorasick.Automaton:
    """Automaton over (slug, term, capitals): a key holds its length and, for each of its terms, slug and exact form or None."""
    by_key: dict[str, list[tuple[str, str | None]]] = {}
    for slug, term, capitals in terms:
        by_key.setdefault(lowered(term), []).append((slug, term if capitals else None))
    out = ahocorasick.Automaton()
    for key, values in by_key.items():
        out.add_word(key, (len(key), values))
    if by_key:
        out.make_automaton()
    return out


def found_in(text: str, machine: ahocorasick.Automaton) -> set[str]:
    """Slugs of the terms that stand in a text between borders."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    out: set[str] = set()
    for end, (size, values) in machine.iter(lowered(text)):
        begin = end - size + 1
        if begin and _WORD.match(text[begin - 1]) or end + 1 < len(text) and _WORD.match(text[end + 1]):
            continue
        out.update(slug for slug, exact in values if exact is None or text[begin : end + 1] == exact)
    return out


def _one_block(df: DataFrame, text: str, terms: list[tuple[str, str, bool]]) -> DataFrame:
    own = df.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(own.value)
        for b in batches:
            got = [sorted(found_in(t, machine) | set(have)) if t and len(machine) else sorted(have) for t, have in zip(b.column(text).to_pylist(), b.column("terms").to_pylist())]
            yield b.set_column(b.schema.get_field_index("terms"), pa.field("terms", pa.list_(pa.string())), pa.array(got, pa.list_(pa.string())))

    return df.mapInArrow(run, df.schema)


def with_terms(df: DataFrame, text: str, terms: DataFrame, block: int = BLOCK) -> DataFrame:
    """``df`` with ``terms`` (replaced if there): the sorted slugs of ``terms`` (slug, term, capitals) found in each text."""
    known = terms.where("length(term) > 0").select(F.col("slug").cast("string"), F.col("term").cast("string"), F.coalesce(F.col("capitals"), F.lit(False))).distinct()
    blocks = max(1, -(-known.count() // block))
    dealt = known.toDF("slug", "term", "capitals").withColumn("block", F.pmod(F.xxhash64("term"), F.lit(blocks)))
    out = df.withColumn("terms", F.array().cast("array<string>"))
    for i in range(blocks):
        # a block is about `block` terms, whatever the size of the dictionary
        out = _one_block(out, text, [tuple(r)[:3] for r in dealt.where(F.col("block") == i).collect()])
    return out
