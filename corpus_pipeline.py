"""A cleaning pipeline over `documents`: each stage works on all that its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandline.llm.exact_dedup import drop_copies
from strandline.llm.jaccard_join import drop_near_copies
from strandline.llm.packing import pack_texts
from strandline.llm.run_index import without_repeats
from strandline.llm.tools import shared_folder
from strandline.llm.toxicity import drop_toxic


# Every stage takes null texts (as empty), empty and very long ones, equal rows, rows that share an identifier, an empty
# table, and further columns of any name, which it hands on (the last one returns its own columns).


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the field finds toxic; equal texts have equal scores, and texts without words stay."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays, of equal rows with it one; null and empty texts are equal."""
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents with a similarity of 0.8 on five-word shingles the smallest doc_id stays; texts without words stay."""
    return drop_near_copies(docs, shingle=5, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller doc_id has are cut from the texts; every row stays, and rows with one doc_id don't cut each other."""
    return without_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of a document with its bin, longest first, ties by doc_id; a text without words is one empty piece."""
    return pack_texts(docs)


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: SQL can't express the trained field, nor the best fit; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written to the cluster's shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
