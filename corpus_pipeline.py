"""Corpus pipeline: quality, near-duplicates, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import packing, quality, similar, templates
from tidemark.llm.common import cut, table


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Null and empty texts go by the mean of the labels; repeated rows stay or go
    together; very long texts are counted in parts; columns of any name stay; without rows or labels nothing goes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles have a Jaccard similarity of 0.8 or more: the smallest doc_id, null last
    (ties: one of the rows). Texts without a word are one group; very long texts are hashed in parts; columns of any name stay."""
    return similar.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; repeated rows stay or go together; very long texts are
    read in parts; columns of any name stay; without a benchmark nothing goes."""
    return templates.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, in sequences of at most 2048 tokens. Null and empty texts are an end mark alone; repeated
    rows are packed each; very long texts are cut; other columns play no part; no rows give no pieces."""
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("near_duplicates", one_of_each), ("decontamination", without_benchmark), ("packing", packed)]

#: Learning, fingerprints and tokens can't be expressed in SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
