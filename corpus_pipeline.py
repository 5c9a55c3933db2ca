"""A training-data pipeline over `documents`: language ID, exact dedup, near-duplicate removal, mixing, packing.

Every stage reads what the one before it wrote. All but the last return the columns of documents.
Stages take null, empty and very long texts, repeated rows, empty tables and extra columns as their
operators do; see there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowloom.llm.common import BATCH, table, written
from rowloom.llm.exact_dedup import deduplicated
from rowloom.llm.jaccard_join import Plan, one_of_each
from rowloom.llm.language_id import identified
from rowloom.llm.mixing import mixed_documents
from rowloom.llm.packing import pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; those without one (null, empty or letterless texts) go."""
    return identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of Jaccard similarity 0.8 on shingles of five words."""
    return one_of_each(docs, Plan(part=80, whole=100, width=5))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights, as whole copies of documents."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids; stored here, as only then texts go to workers in batches of BATCH."""
    return written(pack(docs), batch=BATCH)


STAGES = [("language ID", language_id), ("exact dedup", exact_dedup), ("n-gram Jaccard join", near_dedup), ("mixing", mix), ("packing", packing)]

#: Language prediction, sketches and tokenising are beyond SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs)
    return docs
