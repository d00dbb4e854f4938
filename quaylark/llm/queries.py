"""One query for each training-data operator, over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decontam, gifmedia, langid, mixing, prefixtrie, secrets, simhash, sql, tokencount, tokenfiles, toxicity
from .common import table

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"
END_ID = 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(documents(spark, sf_dir)))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path(BYTE_VOCABULARY)))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    two = F.col("id")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), two.alias("turn"), F.when(two == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.report(chat.format_conversations(turns.unionByName(probe)))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(toxicity.severity_labels(docs, table(spark, sf_dir, "labels")), grades=4)
    return toxicity.grade_severity(docs, model)


def op6_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gifmedia.report(gifmedia.from_media(gifmedia.to_media(documents(spark, sf_dir))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(documents(spark, sf_dir), public_tokenizers.path(WORD_VOCABULARY), END_ID)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(decontam.scan(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.takes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixtrie.prefix_trie(table(spark, sf_dir, "conversations")).drop("rank", "last")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_secrets, op2_simhash, op3_bpe, op4_chat, op5_toxicity, op6_gif, op7_token_counts, op8_language, op9_token_files, op10_decontamination, op11_mixing, op12_collocations, op13_prefix_trie, pipeline)
    return {f.__name__: f for f in own}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets_sql() -> str:
    kinds = []
    for place, (kind, pattern, group, least) in enumerate((*secrets.RULES, *secrets.ADDED)):
        p = _quoted(pattern)
        kinds.append(
            f"SELECT doc_id, {place} AS place, '{kind}' AS kind, {least} AS least, "
            f"regexp_split_to_array(t, {p}) AS pieces, regexp_extract_all(t, {p}, 0) AS whole, regexp_extract_all(t, {p}, {group}) AS counted FROM d"
        )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS ({" UNION ALL ".join(kinds)}),
m AS (
  SELECT doc_id, place, kind, least, i,
    list_sum(list_transform(pieces[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(whole[1:i - 1], lambda x: length(x))), 0)::BIGINT AS s,
    length(whole[i]) AS n, length(counted[i]) AS c
  FROM (SELECT *, unnest(generate_series(1, len(whole))) AS i FROM k WHERE len(whole) > 0)
),
f AS (SELECT doc_id, place, kind, s, kind || ':' || s || ':' || (s + n) AS span FROM m WHERE c >= least),
g AS (
  SELECT doc_id,
    count(*) FILTER (place = 0) AS n_assign, count(*) FILTER (place = 1) AS n_access, count(*) FILTER (place = 2) AS n_hex,
    string_agg(span, ',' ORDER BY s, place) FILTER (place < {len(secrets.RULES)}) AS base, string_agg(span, ',' ORDER BY s, place) AS spans
  FROM f GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (doc_id)"""


def _chat_sql() -> str:
    escaped = r"replace(text, '\', '\0')"
    for string, digit in chat.CONTROL:
        escaped = f"replace({escaped}, '{string}', '\\{digit}')"
    # a raw turn reads back alike unless it holds a control string or an escape
    clash = " OR ".join([f"contains(text, '{s}')" for s, _ in chat.CONTROL] + [f"contains(text, '\\{d}')" for d in "01234"])
    return rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
r AS (
  SELECT *, length(role) + 1 + length(CASE WHEN {clash} THEN {escaped} ELSE text END) + CASE WHEN role = 'assistant' THEN 7 ELSE 13 END AS n FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars
FROM r GROUP BY conv_id"""


def _decontamination_sql() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    n = decontam.WINDOW
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({lower}, '{word}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {n}) AS k, array_to_string(w[i:i + least(len(w), {n}) - 1], ' ') AS s
  FROM (SELECT *, unnest(generate_series(1, greatest(len(w) - {n} + 1, 1))) AS i FROM b WHERE len(w) > 0)
),
ks AS (SELECT DISTINCT k FROM win),
p AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)
),
h AS (SELECT p.doc_id, p.i, p.k, win.item FROM p JOIN win ON p.k = win.k AND p.s = win.s),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS x FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def oracle_sql() -> dict[str, str]:
    return {"op1_secrets": _secrets_sql(), "op4_chat": _chat_sql(), "op10_decontamination": _decontamination_sql(), "op12_collocations": sql.collocations_sql(), "op13_prefix_trie": sql.prefix_trie_sql()}
