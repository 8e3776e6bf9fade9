"""Embedding: text to vectors with a user's function, dimensions, and a report."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable

Embedder = Callable[[list[str]], list[list[float]]]


def hashing_embedder(dims: int = 64) -> Embedder:
    """A deterministic stand-in for a model: signed counts of hashed words, normalised."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dims] += 1 if h >> 63 else -1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


#: Letters that :func:`letter_embedder` counts.
LETTERS = "etaoinshrdlu"


def letter_embedder(texts: list[str]) -> list[list[float]]:
    """Counts of frequent letters at length 1: a stand-in whose vectors SQL can work out too."""
    out = []
    for t in texts:
        v = [float(t.count(x)) for x in LETTERS]
        norm = max(math.sqrt(sum(x * x for x in v)), 1.0)
        out.append([x / norm for x in v])
    return out


def embed_chunks(df: DataFrame, embed: Embedder, text_col: str = "content", batch: int = 100) -> DataFrame:
    """Adds ``embedding``; texts go to ``embed`` in batches, and equal texts of a batch once."""

    @F.pandas_udf("array<float>")
    def vectors(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in series:
            distinct = list(dict.fromkeys(s.fillna("")))
            known: dict[str, list[float]] = {}
            for lo in range(0, len(distinct), batch):
                part = distinct[lo : lo + batch]
                known.update(zip(part, embed(part)))
            yield s.fillna("").map(known.get)

    return df.withColumn("embedding", vectors(text_col))


#: What an embedding cache holds: a text's hash and its vector.
CACHE = "key string, embedding array<float>"


def embedding_cache(spark: SparkSession, path: str, bucket_rows: int = 200_000) -> BucketTable:
    """A cache for :func:`embed_cached`, one per model: vectors by the hash of their text."""
    return BucketTable(spark, path, CACHE, "key", bucket_rows)


def embed_cached(df: DataFrame, embed: Embedder, cache: BucketTable, text_col: str = "content", batch: int = 100) -> DataFrame:
    """C5 with a cache: adds ``embedding``; a text goes to the model once, however often and in whichever run it occurs.

    Texts are told apart by SHA-256.  Those that the cache doesn't know are made distinct, embedded in batches, set
    down, and merged into the cache; vectors come back by a join in which each text has one row, so a text that is
    everywhere can be split among tasks.  Where every text is known the model isn't called.  A run that is lost on the
    way leaves the cache as it was.  Null texts count as empty, as in :func:`embed_chunks`.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = df.withColumn("_key", F.sha2(text, 256))
    texts = df.select(F.sha2(text, 256).alias("key"), text.alias("text")).groupBy("key").agg(F.first("text").alias("text"))
    new = texts.join(cache.read_keys(texts).select("key"), "key", "left_anti")
    draft = f"{cache.path}/fresh-{uuid.uuid4().hex}"
    embed_chunks(new, embed, "text", batch).select("key", "embedding").write.parquet(draft)
    fresh = spark.read.schema(CACHE).parquet(draft)
    if not fresh.isEmpty():
        cache.merge(fresh, lambda held, more: held.join(more.select("key"), "key", "left_anti").unionByName(more))
    cache.delete(draft)
    known = cache.read_keys(texts).select(F.col("key").alias("_key"), "embedding")
    return keyed.drop("embedding").join(known, "_key", "left").drop("_key")


def fit_dimension(vec: Column, dims: int = 1536) -> Column:
    """Cut to ``dims``, or zeros on the right; cosines don't change by padding."""
    return F.when(F.size(vec) >= dims, F.slice(vec, 1, dims)).otherwise(F.concat(vec, F.array_repeat(F.lit(0.0).cast("float"), F.greatest(F.lit(dims) - F.size(vec), F.lit(0)))))


def embedding_report(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per user, chunk rows, valid and invalid embeddings, dimensions seen, distinct titles."""
    size = F.coalesce(F.size("embedding"), F.lit(0))
    d = docs.select(F.col("id").alias("document_id"), "user_id", "title")
    return (
        chunks.select("document_id", size.alias("size")).join(d, "document_id").groupBy("user_id")
        .agg(F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("size") > 0).alias("valid"), F.count_if(F.col("size") <= 0).alias("invalid"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("size") > 0, F.col("size")))).cast("array<string>"), ",").alias("dimensions"), F.countDistinct("title").alias("titles"))
    )
