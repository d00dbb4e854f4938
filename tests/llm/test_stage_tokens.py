"""What the last stage of the pipeline stores."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline


def test_last_stage_stores_the_ids(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.VOCABULARY))
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.encode_tokens(spark, docs, sf_dir).collect()}
    assert got == {r["doc_id"]: library.encode(r["text"] or "", add_special_tokens=False).ids for r in docs.collect()}
