"""Training-corpus pipeline: language ID, near-dedup, decontamination, secrets, tokens.

Each stage works on all rows its predecessor kept, is written as Parquet to the shared
folder and read again. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quaylark.llm import bpe, decontam, langid, secrets, shingles
from quaylark.llm.common import stored, table

VOCABULARY = "byte_bpe_50k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a recognised language."""
    return langid.recognised(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies (five-word shingles, similarity 0.8 or more), the one with the least doc_id."""
    return shingles.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out; drop documents that are mostly benchmark."""
    return decontam.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets by a mark."""
    return secrets.masked(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and the digests of ids and decoded text."""
    return bpe.digests(bpe.round_trip(docs, public_tokenizers.path(VOCABULARY)), "ids")


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", mask_secrets),
    ("bpe_tokens", encode_tokens),
]

#: SQL has neither the SimHash nor the byte-pair merges; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents of ``sf_dir``: the stored token ids with their digests."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digests of the tokens of ``corpus``, whose last stage stores the ids."""
    return corpus(spark, sf_dir).drop("ids")
