"""The corpus pipeline: from all documents to packed training sequences, each stage by one corpus operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelane.llm import gam, packing, rules, shared, similar, suffixes


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at its threshold or more."""
    return gam.keep_good(docs, shared.table(spark, sf_dir, "labels"))


def apply_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules keep."""
    return rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group linked by five-word shingle similarity of 0.8 or more."""
    return similar.keep_one(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that also start in a document with a smaller id."""
    return suffixes.remove_repeats(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokenised documents' pieces and their places in sequences."""
    return packing.pack(packing.pieces_of(docs))


STAGES = [
    ("quality classifier", classify_quality),
    ("quality rules", apply_rules),
    ("near-duplicates", drop_near_duplicates),
    ("repeated passages", cut_repeats),
    ("packing", pack_sequences),
]

#: SQL can't express a trained model; the stages are tested one by one against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table, each one's rows written before the next reads them."""
    docs = shared.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
