"""A training-data pipeline over `documents`: quality filter, exact and near dedup, decontamination, tokenising.

All stages but the last keep the columns of documents, whatever their names. Null texts count as empty; an empty text is
scored, compared and tokenised like any other, so at most one stays. Of rows that repeat id and text one stays; of equal
texts the one with the largest id, of similar ones that with the smallest, a null id being the last choice. An empty
table gives an empty result; without labels the classifier accepts nothing.

The near-duplicate stage is operator 7 on five-word shingles: SimHash fingerprints through Gray-order indexes, then an exact
check of similarity 0.8 or more. Links that differ in more bits than the indexes search are found by their rarest shingles.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tatterloom.llm.bpe_automaton import tokenized
from tatterloom.llm.common import written
from tatterloom.llm.decontaminate import decontaminate
from tatterloom.llm.exact_dedup import exact_dedup
from tatterloom.llm.quality import accepted
from tatterloom.llm.similar import similar_dedup


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the classifier rejects."""
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return similar_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a window of the benchmark."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens, and digests of the ids and of the text decoded from them."""
    return tokenized(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("decontaminate", clean), ("bpe", tokens)]
#: SQL has neither the classifier nor the tokenizer; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"stage-{name}")
    return docs
