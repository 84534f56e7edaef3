"""Corpus pipeline: toxicity, near-dedup, decontamination, mixing, token output.

Each stage takes (spark, docs, sf_dir) and returns documents again, the last one the token corpus.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandwise.llm import decontaminate, mixing, simhash, toxicity
from strandwise.llm.cluster import cut, shared_dir
from strandwise.llm.tokens import read_corpus, write_corpus

SIMILARITY = 0.8
BUDGET = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't predict to be toxic."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, 0.8): those that SimHash and the
    pigeonring find, checked whole, and those whose fingerprints lie further apart."""
    return simhash.without_copies(docs, SIMILARITY)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample that keeps four fifths of the tokens, nearer to the target weights."""
    return mixing.sample(docs, budget=BUDGET)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token corpus, read back: (doc_id, start, n_tokens, ids_crc32)."""
    path = shared_dir(spark)
    write_corpus(docs, path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_corpus(spark, path, with_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix),
    ("token_output", write_tokens),
]
#: SQL expresses neither the classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:  # written and read again, so that no stage runs twice
            docs = cut(docs)
    return docs
