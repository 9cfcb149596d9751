"""Documents to packed sequences: quality rules, near-dedup, substring dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one
before it kept; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siftwood.llm import chunk_dedup, mixing, near_dup, packing, quality
from siftwood.llm.shared import cut
from siftwood.llm.sources import table, tokenizer_path


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; those they reject go."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one of smallest doc_id."""
    return near_dup.drop_near_duplicates(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of smaller doc_id holds, and with n_chars of what is left."""
    from pyspark.sql import functions as F

    left = chunk_dedup.remove_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast(dict(left.dtypes)["n_chars"])) if "n_chars" in left.columns else left


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 4096 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [("quality", good), ("near_dedup", distinct), ("substring_dedup", unrepeated), ("mixing", mixed), ("packing", packed)]

#: The stages rest on hashed sketches, fitted thresholds and a tokenizer; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
