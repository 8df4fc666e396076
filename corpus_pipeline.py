"""Corpus pipeline: quality rules, exact dedup, MinHash near-dedup, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trendspark.llm import exact_dedup, mixing, near_dedup, packing, quality
from trendspark.llm.common import read
from trendspark.session import cut_lineage


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules: documents that fail go."""
    return quality.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact dedup: of rows with equal texts one stays."""
    return exact_dedup.drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near dedup: of documents linked by similar texts one stays."""
    return near_dedup.drop_near_copies(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: each row as often as the mix takes it."""
    return mixing.take_copies(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packing: the pieces of all documents with their places in sequences."""
    return packing.pack(packing.cut_pieces(docs))


STAGES = [("quality rules", good), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]

#: Signatures and tokens are beyond SQL; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut_lineage(docs, name.replace(" ", "-"))
    return docs
