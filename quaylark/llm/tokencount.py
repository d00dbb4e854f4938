"""Token counts with a whole-token shortcut.

Offline, on the driver, every string of the vocabulary is encoded alone by the
merge rules; those that give exactly one token are proven whole tokens. Counting
then looks pre-tokens up among the proven strings and adds one for each; only the
rest is merged. The set of proven strings is as large as the vocabulary at most.

Edge cases: null and empty texts count 0 tokens; a text of white space only counts
what the vocabulary gives it; special strings inside a text count as their special
id, as the library does by default; repeated rows give one row each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import CHARS_KEPT, CHUNKS_KEPT, Codec, _two, codec
from .common import by_size, in_batches, texts_of

MAX_TOKENS = 2048


def proven_whole_tokens(path: str) -> frozenset[str]:
    """Vocabulary strings that are one pre-token and that the merge rules encode as one token."""
    own = codec(path)
    strings = set()
    for raw in own.token_bytes:
        try:
            text = raw.decode().removesuffix(" ") if own.by_words else raw.decode()
        except UnicodeDecodeError:
            continue
        if text and own.pretokens(text) == [text]:
            strings.add(text)
    ordered = sorted(strings)
    return frozenset(t for t, n in zip(ordered, own.merge_pretokens(ordered)[1].tolist()) if n == 1)


class Counter:
    """Counts tokens of texts; keeps the counts of chunks seen, up to ``CHUNKS_KEPT`` and ``CHARS_KEPT``."""

    def __init__(self, own: Codec, whole: frozenset[str]):
        self.own, self.whole, self.seen, self.chars = own, whole, {}, 0

    def learn(self, chunks: list[str]) -> None:
        rest: list[tuple[str, list[str]]] = []
        for c in chunks:
            if c in self.own.special_chunk:
                self.seen[c] = 1
                continue
            parts = self.own.pretokens(c)
            others = [p for p in parts if p not in self.whole]
            self.seen[c] = len(parts) - len(others)
            if others:
                rest.append((c, others))
        words = list(dict.fromkeys(chain.from_iterable(o for _, o in rest)))
        sizes = dict(zip(words, self.own.merge_pretokens(words)[1].tolist()))
        for c, others in rest:
            self.seen[c] += sum(sizes[p] for p in others)

    def count(self, texts: list[str]) -> list[int]:
        cuts = [self.own.cut(t) for t in texts]
        new = set().union(*cuts) - self.seen.keys()
        if len(self.seen) >= CHUNKS_KEPT or self.chars >= CHARS_KEPT:
            self.seen, self.chars = {}, 0
            new = set().union(*cuts)
        self.learn(sorted(new))
        self.chars += sum(map(len, new))
        size = self.seen.__getitem__
        return [sum(map(size, c)) for c in cuts]


def count_tokens(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    whole = docs.sparkSession.sparkContext.broadcast(proven_whole_tokens(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(codec(path), whole.value)
        for b in by_size(batches):
            n = pa.array(counter.count(texts_of(b)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), n], ["doc_id", "n_bytes", "n_tokens"])

    rows = _two(docs, id_col, text_col).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))
    return in_batches(rows, run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > max_tokens)
