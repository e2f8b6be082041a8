"""Corpus pipeline: toxic documents and near copies out, benchmark leaks out, personal data redacted, sources mixed.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns: null and
empty texts are kept by the filters (of nulls one row, of empty texts one, as near copies of each other), rows without an
id are held out of learning and kept, columns besides those of documents pass through, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrylens.llm import decontaminate, mixing, near_copies, pii, toxicity
from quarrylens.llm.shared import held_out, read_table, store


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.7 or more go; learned as in op1, from the rows of ``docs`` that aren't held out."""
    labels = read_table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"), 3)).select("doc_id", "toxic")
    lexicon = toxicity.learn(docs.where(~held_out(F.col("doc_id"), 3)), labels)
    return toxicity.reject(docs, lexicon, 0.7)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: linked by SimHash, then by sets of five-word shingles; Jaccard index 0.8 or more."""
    return near_copies.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, also with other numbers, names or units, go."""
    return decontaminate.clean(docs, read_table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; spans of personal data are replaced by their kind, and n_chars follows."""
    return pii.redact(docs, pii.learn(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document: doc_id, source, size, source_size, target and taken words, repeats counted."""
    return mixing.mix(docs, mixing.label_quality(read_table(spark, sf_dir, "labels")))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: Learned models, fingerprints and Jaccard verification have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
