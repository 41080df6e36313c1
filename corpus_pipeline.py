"""The training-data pipeline: each stage works on all rows that the one before kept.

Stages hand on Parquet tables with the columns of ``documents``; the last
returns packed pieces.  SQL can't express the classifier, so there is no SQL
for the whole; tests hold each stage against a brute-force version.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from fluxlens.llm import lines, mixing, neardup, packing, quality
from fluxlens.llm.common import written

ORACLE_SQL = None


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.good_documents(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more stay in one of them; documents of which no line is left go."""
    return lines.without_repeated_lines(docs, min_docs=10, min_chars=1)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (shingles of five words, similarity 0.8)."""
    return neardup.one_of_each(docs, words=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to their targets: a row for each pass over a document, with the words it takes."""
    return mixing.mixed_documents(docs, share=1.5, most=2, cycle=(5, 2, 1), block_words=64)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


STAGES = [
    ("quality", keep_good),
    ("lines", drop_repeated_lines),
    ("near_duplicates", keep_one_of_each),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each but the last written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
