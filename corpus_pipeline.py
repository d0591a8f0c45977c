"""Documents to packed sequences: quality, toxicity, exact copies, near copies, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import exact_dedup, near_dedup, packing, quality, toxicity
from ledgerloom.llm.common import load
from ledgerloom.scratch import written


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier, learnt from this table's labelled documents, accepts.

    Null texts are scored as empty ones; a null id has no label and is scored like any other. Rows of equal texts, and
    rows that repeat, share a fate. A score at the threshold is accepted. Without labels of both kinds all documents have
    one score, the share of good labels. An empty table stays empty. All columns are handed on as they are.
    """
    model = quality.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.only(docs, model, accept=1, threshold=quality.THRESHOLD)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the toxicity classifier, learnt from this table's labelled documents, doesn't mark.

    Nulls, repeats, empty tables and other columns as for quality; a score at the threshold is marked.
    """
    model = toxicity.fit(docs, load(spark, sf_dir, "labels"))
    return toxicity.only(docs, model, accept=0, threshold=0.5)


def one_of_equal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents of one text, the one with the largest id.

    Null texts are equal to empty ones. A null id stays only where all ids of its text are null; of rows that repeat id
    and text one stays, the one whose other columns have the least hash. An empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest id.

    Null texts are empty ones; texts without words are like equal texts only. A null id is in no class and stays. Rows
    that repeat an id share its class and stay or go together. An empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, in sequences of 2048 tokens.

    Null and empty texts are one token, their end. Ids may be null or repeat: each row is packed. An empty table gives
    no pieces.
    """
    return packing.packed(docs)


STAGES = [
    ("quality", good_quality), ("toxicity", not_toxic), ("exact copies", one_of_equal), ("near copies", one_of_near), ("packing", into_sequences),
]

#: Classifiers, sampling and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written to the shared folder and read by the next."""
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
