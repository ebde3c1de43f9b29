"""Five stages from raw documents to token ids: quality, exact copies, near copies, mix, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as Parquet and read again.
Columns beyond those of documents pass through untouched. An empty table stays empty; null texts count as empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from mendline.llm import extendible_dedup, near_texts, piece_dropout, rule_ensemble, source_mix
from mendline.llm.common import read, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    return rule_ensemble.keep_good(docs, read(spark, sf_dir, "labels"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts."""
    return extendible_dedup.keep_one(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, a Jaccard similarity of 0.8 or more.

    Candidates come from a SimHash ring, and from minima where the ring's budget does not reach; each is checked on the whole sets.
    """
    return near_texts.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, the last time up to the word where the mix ends."""
    return source_mix.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece_ids, n_ids, lossless."""
    return piece_dropout.round_trip(docs, copies=True)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: Classifier, fingerprints and encoding are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what lies between them is written to the shared folder."""
    docs = read(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
