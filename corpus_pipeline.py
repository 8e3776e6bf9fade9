"""The corpus pipeline: toxicity, exact dedup, near-dedup, substring dedup, packing.

Each stage takes all that its predecessor kept, from Parquet in the shared folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docfold.llm.common import crc32_mod, materialize, table
from docfold.llm.exact_dedup import drop_exact_duplicates
from docfold.llm.minhash import drop_near_duplicates
from docfold.llm.packing import pack_documents
from docfold.llm.suffix_dedup import drop_repeats
from docfold.llm.toxicity import drop_toxic, train_toxicity


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    labels = table(spark, sf_dir, "labels").filter(crc32_mod(F.col("doc_id"), 5) != 0)
    return drop_toxic(docs, train_toxicity(docs, labels))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the smallest id stays."""
    return drop_exact_duplicates(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more, the one with the smallest id stays."""
    return drop_near_duplicates(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 100 bytes or more that occur earlier go; ``n_chars`` follows."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens."""
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_duplicates),
    ("minhash_dedup", near_duplicates),
    ("suffix_dedup", repeated_passages),
    ("packing", packing),
]

#: SQL can't express the classifier, the sketches' components or the cuts: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
