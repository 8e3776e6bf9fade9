"""Vector search for many queries at once."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ties between equal similarities are broken by these, so that ranks are total.
TIES = ["document_id", "chunk_index", "chunk_id"]


def cosine_similarity(a: Column, b: Column) -> Column:
    """V1: cosine in double; 0 where lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def unit_vector(v: Column) -> Column:
    """The vector in double at length 1; zeros stay zeros."""
    wide = F.transform(v, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda s, x: s + x * x))
    return F.when(norm > 0, F.transform(wide, lambda x: x / norm)).otherwise(wide)


def unit_product(a: Column, b: Column) -> Column:
    """Cosine of vectors that :func:`unit_vector` has given; 0 where lengths differ."""
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), dot).otherwise(0.0)


def user_chunks_for_search(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """``user_id, chunk_id, document_id, chunk_index, content, title, embedding`` of chunks with a vector."""
    d = docs.select(F.col("id").alias("document_id"), "user_id", "title")
    return chunks.filter("embedding is not null").select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "content", "embedding").join(d, "document_id")


def similarity_search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, k: int | Column = 25, least: float = 0.1, keys: tuple[str, ...] = ("query_id",), most: int = 50) -> DataFrame:
    """V2: each query's ``k`` (50 at most) most similar chunks of its user, with ``similarity`` and ``rank``.

    ``queries`` has ``keys``, ``user_id`` and ``embedding``.  Built-in expressions: each vector is brought to
    length 1 once, queries meet the vectors of their user's chunks by an equi-join on the user (AQE splits the
    partition of a large user), and the rank window keeps ``k`` rows per query before the shuffle.  Contents and
    titles join the ranked rows.
    """
    limit = F.least(F.lit(k) if isinstance(k, int) else k, F.lit(most))
    ranked = ranked_chunks(queries, chunks, docs, keys).filter((F.col("rank") <= limit) & (F.col("similarity") >= least))
    return with_contents(ranked, chunks, docs).select(*keys, "user_id", "rank", "chunk_id", "document_id", "chunk_index", "content", "title", "similarity")


def ranked_chunks(queries: DataFrame, chunks: DataFrame, docs: DataFrame, keys: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """All chunks of each query's user with ``similarity`` and ``rank``, ids only.

    A floor belongs after the rank: a filter before it would be computed with the product, and that twice.
    """
    q = queries.select(*keys, "user_id", unit_vector(F.col("embedding")).alias("q"))
    c = user_chunks_for_search(chunks, docs).select("user_id", "chunk_id", "document_id", "chunk_index", unit_vector(F.col("embedding")).alias("v"))
    scored = c.join(q, "user_id").withColumn("similarity", unit_product(F.col("v"), F.col("q"))).drop("v", "q")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("similarity"), *TIES)))


def with_contents(hits: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds ``content`` and ``title`` to rows of ``chunk_id`` and ``document_id``."""
    c = chunks.select(F.col("id").alias("chunk_id"), "content")
    return hits.join(c, "chunk_id").join(docs.select(F.col("id").alias("document_id"), "title"), "document_id")


def bulk_similarity_search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = 25, least: float = 0.1, keys: tuple[str, ...] = ("query_id",), slot_rows: int = 20_000, query_rows: int = 1024) -> DataFrame:
    """V2 in bulk, with the rows and columns of :func:`similarity_search`: one matrix product for each slot and block.

    A user's chunks are dealt into slots of about ``slot_rows`` and its queries into blocks of about ``query_rows``.
    Every slot meets every block in a task of its own, which keeps ``k`` rows per query; so neither a large user nor a
    user with many queries is one task, and a task's size doesn't grow.  Only ids and similarities are shuffled on, and
    contents join the final rows.  Similarities are rounded at 12 decimals, so equal vectors tie.
    """
    k = min(k, 50)
    base = user_chunks_for_search(chunks, docs).select("user_id", "chunk_id", "document_id", "chunk_index", "embedding")
    asked = queries.select(*keys, "user_id", F.col("embedding").alias("q")).filter("q is not null")
    slots = base.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / slot_rows).alias("slots"))
    blocks = asked.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / query_rows).alias("blocks"))
    deal = slots.join(blocks, "user_id")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    c = base.join(deal, "user_id").withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.col("slots"))).withColumn("block", each("blocks")).drop("slots", "blocks")
    q = asked.join(deal, "user_id").withColumn("block", F.pmod(F.xxhash64(*keys), F.col("blocks"))).withColumn("slot", each("slots")).drop("slots", "blocks")
    types = ", ".join(f"{n} {queries.schema[n].dataType.simpleString()}" for n in keys)

    def unit(m: np.ndarray) -> np.ndarray:
        return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            left = left.sort_values(["document_id", "chunk_index", "chunk_id"], ignore_index=True)
            # Vectors of different lengths have no similarity.
            for d in left["embedding"].map(len).unique():
                there, mine = left[left["embedding"].map(len) == d], right[right["q"].map(len) == d]
                if not len(mine) or not d:
                    continue
                sims = np.round(unit(np.stack(mine["q"]).astype(float)) @ unit(np.stack(there["embedding"]).astype(float)).T, 12)
                for row, s in zip(mine[list(keys)].itertuples(index=False), sims):
                    top = np.argsort(-s, kind="stable")[:k]
                    top = top[s[top] >= least]
                    out.append(there.iloc[top][["chunk_id", "document_id", "chunk_index"]].assign(**dict(zip(keys, row)), similarity=s[top]))
        none = pd.DataFrame({n: [] for n in (*keys, "chunk_id", "document_id", "chunk_index", "similarity")})
        return (pd.concat(out) if out else none)[[*keys, "chunk_id", "document_id", "chunk_index", "similarity"]]

    met = ["user_id", "slot", "block"]
    found = c.groupBy(*met).cogroup(q.groupBy(*met)).applyInPandas(search, f"{types}, chunk_id long, document_id long, chunk_index int, similarity double")
    best = Window.partitionBy(*keys).orderBy(F.desc("similarity"), *TIES)
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).join(queries.select(*keys, "user_id"), list(keys))
    return with_contents(ranked, chunks, docs).select(*keys, "user_id", "rank", "chunk_id", "document_id", "chunk_index", "content", "title", "similarity")


def retrieve_batch(questions: DataFrame, chunks: DataFrame, docs: DataFrame, k: int = 5, least: float = 0.4) -> DataFrame:
    """Sources of many questions, without reranking."""
    hits = similarity_search(questions, chunks, docs, k, least)
    return hits.select("query_id", "rank", "chunk_id", "content", F.coalesce("title", F.lit("Unknown Document")).alias("title"), F.col("similarity").alias("score"))


def similarity_profile(queries: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Per query over all its user's chunks, extremes and mean (3 decimals), counts over steps, ten best."""
    s = ranked_chunks(queries, chunks, docs).select("query_id", "chunk_id", "similarity")
    three = lambda x: F.floor(x * 1000 + 0.5) / 1000
    all_ = s.groupBy("query_id").agg(
        three(F.max("similarity")).alias("max_similarity"), three(F.min("similarity")).alias("min_similarity"), three(F.avg("similarity")).alias("avg_similarity"),
        *[F.count_if(F.col("similarity") >= x).alias(f"over_{int(x * 100)}") for x in (0.4, 0.3, 0.2)],
    )
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "chunk_id")
    top = s.withColumn("rank", F.row_number().over(w)).filter("rank <= 10").groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"].cast("string")), ",").alias("top_chunks"))
    return all_.join(top, "query_id")


def threshold_sweep(queries: DataFrame, chunks: DataFrame, docs: DataFrame, settings: list[tuple[int, float, bool]], limit: int = 10) -> DataFrame:
    """Per query and setting (its number, floor, and whether the floor is dynamic), result count and best chunk.

    The search runs once, at the lowest floor; settings only filter its rows.  Counts follow from ranks.
    """
    from ..functions.text import dynamic_threshold

    hits = similarity_search(queries, chunks, docs, limit, 0.1).select("query_id", "chunk_id", "similarity", "rank")
    asked = queries.select("query_id", "text", F.explode(F.array(*[F.struct(F.lit(n).alias("setting"), F.lit(least).alias("least"), F.lit(dynamic).alias("dynamic")) for n, least, dynamic in settings])).alias("s")).select("query_id", "text", "s.*")
    asked = asked.withColumn("floor", F.when(F.col("dynamic"), dynamic_threshold("text", F.col("least"))).otherwise(F.col("least")))
    met = asked.join(hits, "query_id", "left").withColumn("ok", F.coalesce(F.col("similarity") >= F.col("floor"), F.lit(False)))
    return met.groupBy("query_id", "setting").agg(F.count_if("ok").alias("results"), F.min_by("chunk_id", F.when(F.col("ok"), F.col("rank"))).alias("best_chunk"))


def train_lists(chunks: DataFrame, lists: int = 100, sample: int = 20_000, seed: int = 5) -> KMeansModel:
    """V18, index: centroids from at most ``sample`` normalised vectors (chosen by hash order)."""
    unit = _unit(chunks.filter("embedding is not null")).orderBy(F.xxhash64("id")).limit(sample)
    return KMeans(k=lists, seed=seed, featuresCol="unit", predictionCol="list").fit(unit)


def _unit(df: DataFrame) -> DataFrame:
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return df.filter(norm > 0).withColumn("unit", array_to_vector(F.transform("embedding", lambda x: x.cast("double") / norm)))


def approx_search(queries: DataFrame, chunks: DataFrame, docs: DataFrame, model: KMeansModel, k: int = 10, least: float = 0.1, probes: int = 10) -> DataFrame:
    """V2 within the ``probes`` lists whose centroids are nearest to a query.

    All chunks are indexed; a query meets its lists' chunks by an equi-join on user and list.
    """
    centres = np.array([np.asarray(c, float) for c in model.clusterCenters()])
    centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-300)

    @F.pandas_udf("array<int>")
    def nearest_lists(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype=object)
        return pd.Series(list(np.argsort(-(np.stack(vectors).astype(float) @ centres.T), axis=1, kind="stable")[:, :probes].astype(np.int32)))

    q = queries.select("query_id", "user_id", unit_vector(F.col("embedding")).alias("q"), F.explode(nearest_lists("embedding")).alias("list"))
    listed = model.transform(_unit(chunks)).select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "list", vector_to_array("unit").alias("v"))
    c = listed.join(docs.select(F.col("id").alias("document_id"), "user_id"), "document_id")
    scored = c.join(q, ["user_id", "list"]).withColumn("similarity", unit_product(F.col("v"), F.col("q"))).drop("v", "q")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *TIES)
    return scored.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("similarity") >= least)).select("query_id", "rank", "chunk_id", "document_id", "chunk_index", "similarity")


def search_recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Per query of ``exact``, how many of its chunks ``found`` has: ``query_id, wanted, found, recall``."""
    hits = exact.select("query_id", "chunk_id").join(found.select("query_id", "chunk_id", F.lit(1).alias("hit")), ["query_id", "chunk_id"], "left")
    n = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("wanted"), F.count("hit").alias("found"))
    return n.withColumn("recall", F.col("found") / F.col("wanted"))


def tune_search_params(chunks: DataFrame, docs: DataFrame, recall: float = 0.9) -> DataFrame:
    """Per user, lists and probes for its number of vectors, and the estimated time."""
    d = docs.select(F.col("id").alias("document_id"), "user_id")
    n = chunks.filter("embedding is not null").groupBy("document_id").count().join(d, "document_id").groupBy("user_id").agg(F.sum("count").alias("vectors"))
    lists = F.greatest(F.lit(10), F.least(F.lit(1000), F.floor(F.col("vectors") / 1000)))
    n = n.withColumn("lists", lists)
    n = n.withColumn("probes", F.greatest(F.lit(1), F.least(F.lit(100), F.ceil(F.col("lists") * F.lit(1 - recall) * 2))))
    return n.withColumn("estimated_ms", F.col("vectors") * 0.1 * F.col("probes") / F.col("lists"))
