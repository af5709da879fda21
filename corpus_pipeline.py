"""A corpus pipeline of five stages over the table documents; each reads all that the stage before it kept.

Stages are functions of (spark, docs, sf_dir); the result of one is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents.

Defined cases: a null text counts as empty in every stage, and empty texts are scored, folded, linked and packed like
others; null identifiers sort last, so such a row stays only where its whole group has none; rows that repeat identifier
and text are reduced to one by the exact stage; columns beyond those of documents pass through the first four stages under
their own names, whatever these are; without labels nothing is rejected; an empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import classifier, exact_dedup, mixing, packing
from millrace.llm import near as nearcopies
from millrace.llm.common import shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble rejects go."""
    model = classifier.fit(docs, table(spark, sf_dir, "labels"), ~classifier.held_out(F.col("__id")))
    return classifier.accepted(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest identifier stays."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of documents linked at five words and similarity 0.8 that with the smallest identifier stays."""
    return nearcopies.deduplicate(docs, shingle=5, similarity=0.8)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; documents that the mix repeats are rows of their own."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as windows of token ids."""
    return packing.digest_columns(packing.pack(docs))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("near-dedup", near),
    ("mixing", mixed),
    ("packing", packed),
]

#: SQL can't express a trained classifier, XXH64 shingles or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
