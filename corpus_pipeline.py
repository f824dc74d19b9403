"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.

All stages but the last return the columns of ``documents``; the last returns the packed pieces. A filter keeps
a row unless its operator rejects it; rows are never sampled or cut.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenix.llm import exact_dedup, language_id, minhash, packing, quality
from lumenix.llm.common import materialize, table

#: Below this calibrated probability a text counts as of no known language.
LANGUAGE_THRESHOLD = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a known language: a letter at least, and a calibrated probability of the threshold or more."""
    return language_id.annotate(docs, language_id.fit(language_id.training_rows(docs)), threshold=LANGUAGE_THRESHOLD)


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what the quality classifier predicts as 1, at its threshold."""
    p = quality.QualityParams()
    return quality.annotate(docs, quality.learn(docs, table(spark, sf_dir, "labels"), p), p, threshold=p.threshold)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group at five-word shingles and a similarity of 0.8."""
    return minhash.keep_first(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("quality", classify_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

#: Trained classifiers cannot be expressed in SQL; tests hold the run against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
