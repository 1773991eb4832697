"""The document pipeline: four stages, each on all rows its predecessor kept.

Stages, in order: the quality classifier, near duplicates, benchmark passages, tokens.
All but the last return the columns of ``documents``; the last returns what is left, as
tokens.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reqsieve.llm import decontaminate, forced_bpe, neardup, quality
from reqsieve.llm.queries import quality_model
from reqsieve.session import cut_lineage, prepare


def quality_classifier(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier does not reject."""
    return quality.keep_good(docs, quality_model(prepare(spark), folder, docs))


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near copies: that of the smallest id."""
    return neardup.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without any passage of the benchmark."""
    return decontaminate.decontaminate(docs, prepare(spark).read.parquet(f"{folder}/benchmark.parquet"))


def encode_decode(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Number and digests of the tokens of each document left, and of their decoded text."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return forced_bpe.encode_decode(docs, path, ["doc_id"], outputs=("ids_sha256", "decoded_sha256"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("encode_decode", encode_decode),
]

#: SQL cannot express a learned classifier; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = prepare(spark).read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
