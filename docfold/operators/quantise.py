"""V18 by product quantisation: short codes for every vector, tables of distances per query, exact re-ranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .vector import TIES, unit_product, unit_vector


@dataclass(frozen=True)
class Codebooks:
    """List centres (lists x dimensions), and for each sub-vector its code words (parts x words x width)."""

    centres: np.ndarray
    words: np.ndarray

    @property
    def dims(self) -> int:
        return self.centres.shape[1]

    def lists(self, v: np.ndarray, probes: int) -> np.ndarray:
        """The ``probes`` lists whose centres are nearest, nearest first."""
        return np.argsort(((self.centres**2).sum(1) - 2 * v @ self.centres.T), axis=1, kind="stable")[:, :probes]

    def encode(self, residual: np.ndarray) -> np.ndarray:
        """The nearest code word of each sub-vector, a byte each."""
        n, (parts, _, width) = len(residual), self.words.shape
        cut = residual.reshape(n, parts, width)
        far = (self.words**2).sum(2)[None] - 2 * np.einsum("npw,pkw->npk", cut, self.words)
        return far.argmin(2).astype(np.uint8)

    def products(self, q: np.ndarray) -> np.ndarray:
        """A query's table: its product with every code word of every sub-vector."""
        parts, _, width = self.words.shape
        return np.einsum("pw,pkw->pk", q.reshape(parts, width), self.words)


def _k_means(x: np.ndarray, k: int, rounds: int = 15) -> np.ndarray:
    """``k`` means of the rows, from rows spread over their order; an empty cluster takes the row that is furthest off."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        far = (centres**2).sum(1) - 2 * x @ centres.T
        at = far.argmin(1)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        fresh = sums / np.maximum(n, 1)[:, None]
        lost = np.flatnonzero(n == 0)
        if len(lost):
            off = far[np.arange(len(x)), at] + (x**2).sum(1)
            fresh[lost] = x[np.argsort(-off, kind="stable")[np.arange(len(lost)) % len(x)]]
        if np.array_equal(fresh, centres):
            break
        centres = fresh
    return centres


def train_codebooks(chunks: DataFrame, lists: int = 100, parts: int = 16, words: int = 256, sample: int = 20_000, seed: int = 5) -> Codebooks:
    """Centres of the lists, and code words for what is left of vectors after their list's centre is taken away.

    Fits on at most ``sample`` unit vectors, chosen by hash order; the number of dimensions must be divisible by
    ``parts``.  Every sub-vector's words are a task of their own, over the sample's rows of that sub-vector.
    """
    unit = chunks.filter("embedding is not null").select("id", unit_vector(F.col("embedding")).alias("v")).filter(F.size("v") > 0)
    held = unit.orderBy(F.xxhash64("id"), "id").limit(sample)
    model = KMeans(k=lists, seed=seed, featuresCol="f").fit(held.select(array_to_vector("v").alias("f")))
    centres = np.array(model.clusterCenters())
    dims = centres.shape[1]
    if dims % parts:
        raise ValueError("the vectors' dimensions must be divisible by the number of parts")
    width = dims // parts
    cut = F.array(*[F.slice("r", p * width + 1, width) for p in range(parts)])
    left = held.select("id", _residuals(centres)("v").alias("r")).select("id", F.posexplode(cut).alias("part", "x"))

    def fit(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")
        book = _k_means(np.asarray(rows["x"].combine_chunks().flatten()).reshape(-1, width), words)
        return pa.table({"part": pa.array([rows["part"][0].as_py()], pa.int32()), "book": pa.array([book.ravel().tolist()])})

    books = np.zeros((parts, words, width))
    for r in left.groupBy("part").applyInArrow(fit, "part int, book array<double>").collect():
        books[r.part] = np.array(r.book).reshape(words, width)
    return Codebooks(centres, books)


def _residuals(centres: np.ndarray):
    @F.pandas_udf("array<double>")
    def residual(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype=object)
        x = np.stack(v)
        return pd.Series(list(x - centres[((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)]))

    return residual


CODED = "chunk_id long, document_id long, chunk_index int, list int, code binary, error double"
#: Vectors that one step codes: each takes parts x words distances.
STEP = 256
#: What rounding may take from a bound.
SLACK = 1e-4


def encode_chunks(chunks: DataFrame, books: Codebooks) -> DataFrame:
    """The index: ``chunk_id, document_id, chunk_index, list, code, error`` of every chunk with a vector of the right length.

    A code is one byte for each sub-vector of what is left after the list's centre; ``error`` is how far the vector is
    from what its code stands for, which no estimate exceeds.  Write it as a table, by list.
    """
    parts = np.arange(books.words.shape[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in (b.slice(lo, STEP) for lo in range(0, b.num_rows, STEP)):
                x = np.asarray(some.column("v").flatten()).reshape(some.num_rows, books.dims)
                at = books.lists(x, 1)[:, 0]
                left = x - books.centres[at]
                code = books.encode(left)
                error = np.linalg.norm(left - books.words[parts, code].reshape(left.shape), axis=1)
                yield pa.RecordBatch.from_arrays([some.column("chunk_id"), some.column("document_id"), some.column("chunk_index"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(error)], ["chunk_id", "document_id", "chunk_index", "list", "code", "error"])

    rows = chunks.filter(F.size("embedding") == books.dims).select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", unit_vector(F.col("embedding")).alias("v"))
    return rows.mapInArrow(run, CODED)


def coded_candidates(queries: DataFrame, index: DataFrame, docs: DataFrame, books: Codebooks, candidates: int, probes: int, slot_rows: int = 50_000, k: int | None = None) -> DataFrame:
    """``query_id, chunk_id, document_id``: the best ``candidates`` of each query by its tables, from codes alone.

    Queries meet the codes of their user's chunks by user, list and slot: a list has a slot for each ``slot_rows`` codes
    of a user, so neither a large user nor a large list is one task.  A slot gives out ``candidates`` rows per query,
    and so does the window over slots.  With ``k``, rows after the first 2 ``k`` go if at least ``k`` others are more
    similar by the bounds that the codes' errors give: they aren't among the best ``k``, however many candidates there are.
    """
    near = 2 * k if k is not None else candidates

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                at = books.lists(np.asarray(b.column("q").flatten()).reshape(b.num_rows, books.dims), min(probes, len(books.centres)))
                take = pa.array(np.repeat(np.arange(b.num_rows), at.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("query_id").take(take), b.column("user_id").take(take), pa.array(at.ravel().astype(np.int32)), b.column("q").take(take)], ["query_id", "user_id", "list", "q"])

    asked = queries.filter(F.size("embedding") == books.dims).select("query_id", "user_id", unit_vector(F.col("embedding")).alias("q")).mapInArrow(lists, "query_id long, user_id long, list int, q array<double>")
    owned = index.join(docs.select(F.col("id").alias("document_id"), "user_id"), "document_id")
    slots = owned.groupBy("user_id", "list").agg(F.ceil(F.count(F.lit(1)) / slot_rows).alias("slots"))
    codes = owned.join(slots, ["user_id", "list"]).withColumn("slot", F.pmod(F.xxhash64("chunk_id"), F.col("slots"))).drop("slots")
    sent = asked.join(slots, ["user_id", "list"]).withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1))).drop("slots")
    parts = books.words.shape[0]

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            code = np.frombuffer(b"".join(left["code"].to_pylist()), np.uint8).reshape(left.num_rows, parts)
            chunk, document, error = (np.asarray(left[c].combine_chunks()) for c in ("chunk_id", "document_id", "error"))
            centre = books.centres[left["list"][0].as_py()]
            for q, x in zip(right["query_id"].to_pylist(), right["q"]):
                x = np.array(x.as_py())
                table = books.products(x).astype(np.float32)
                s = np.full(len(code), x @ centre)
                for p in range(parts):
                    s += table[p, code[:, p]]
                low = np.where(np.isnan(s - error), -np.inf, s - error)
                top = np.arange(len(s))
                if k is not None and len(s) > near:
                    bound = np.partition(low, -k)[-k] - SLACK
                    least = np.partition(s, -near)[-near]
                    top = np.flatnonzero(~((s + error < bound) & (s < least)))
                if len(top) > candidates:
                    top = top[np.lexsort((chunk[top], -s[top]))[:candidates]]
                out.append(pa.table({"query_id": np.full(len(top), q, np.int64), "chunk_id": chunk[top], "document_id": document[top], "estimate": s[top], "low": low[top], "high": s[top] + error[top]}))
        return pa.concat_tables([found_schema.empty_table(), *out])

    found_schema = pa.schema([(c, pa.int64()) for c in ("query_id", "chunk_id", "document_id")] + [(c, pa.float64()) for c in ("estimate", "low", "high")])
    keys = ["user_id", "list", "slot"]
    met = codes.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(best, "query_id long, chunk_id long, document_id long, estimate double, low double, high double")
    w = Window.partitionBy("query_id").orderBy(F.desc("estimate"), "chunk_id")
    ranked = met.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= candidates)
    if k is not None and candidates > near:
        at = ranked.withColumn("_low", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("low"))))
        bound = F.max(F.when(F.col("_low") == k, F.col("low"))).over(Window.partitionBy("query_id")) - SLACK
        ranked = at.withColumn("_bound", bound).filter((F.col("_n") <= near) | F.col("_bound").isNull() | (F.col("high") >= F.col("_bound"))).drop("_low", "_bound")
    return ranked.drop("_n", "low", "high")


def quantised_search(queries: DataFrame, index: DataFrame, chunks: DataFrame, docs: DataFrame, books: Codebooks, k: int = 10, least: float = 0.1, probes: int = 10, candidates: int = 50) -> DataFrame:
    """``query_id, rank, chunk_id, document_id, chunk_index, similarity``: the best ``k`` by exact similarity.

    Only ``candidates`` vectors of each query are read: those with the highest estimates from codes, without those
    that their bounds exclude (:func:`coded_candidates`).
    """
    found = coded_candidates(queries, index, docs, books, candidates, probes, k=k).select("query_id", "chunk_id")
    v = chunks.select(F.col("id").alias("chunk_id"), "document_id", "chunk_index", "embedding")
    exact = found.join(v, "chunk_id").join(queries.select("query_id", F.col("embedding").alias("asked")), "query_id")
    scored = exact.withColumn("similarity", unit_product(unit_vector(F.col("embedding")), unit_vector(F.col("asked")))).drop("embedding", "asked")
    best = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *TIES)
    return scored.withColumn("rank", F.row_number().over(best)).filter((F.col("rank") <= k) & (F.col("similarity") >= least)).select("query_id", "rank", "chunk_id", "document_id", "chunk_index", "similarity")
