"""The corpus pipeline: quality rules, line dedup, near-dedup, mixing, packing, each stage written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slotledger.llm import line_dedup, mixing, packing, quality, simhash
from slotledger.llm.common import documents, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the outlier test reject go."""
    return quality.keep_good(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that an earlier document has go; every document stays, if need be with an empty text. n_chars follows the text."""
    return line_dedup.cut_passages(docs)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated or left out by their leaf's budget."""
    return mixing.materialise(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their place in a sequence; a document that is there twice is packed twice."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("simhash near-dedup", dedup_near),
    ("mixing", mix_sources),
    ("best-fit packing", pack_sequences),
]

#: XXH64 fingerprints and byte-pair ids have no SQL counterpart; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
