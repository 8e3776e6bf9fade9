"""Exact top-k search with vector-approximation files.

Each block of vectors is stored as quantised cells, one byte per component.  For a query, the cells alone give
an upper bound of every inner product; exact vectors are then read in the order of those bounds until the k-th
best exact score is above every bound that is left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches

#: Cells per component; their numbers fit one byte.
CELLS = 256


class ApproximationFile:
    """Cells of integer vectors, which every search scans, and the exact vectors, which it reads one by one."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        low, high = self.vectors.min(0), self.vectors.max(0)
        self.low, self.width = low.astype(float), np.maximum(np.ceil((high - low + 1) / CELLS), 1).astype(float)
        self.cells = ((self.vectors - low) // self.width.astype(np.int64)).astype(np.uint8)
        #: Exact vectors read so far.
        self.reads = 0

    def bounds(self, queries: np.ndarray, step: int = 2048) -> np.ndarray:
        """Upper bounds of every product, queries x rows, from the cells alone.

        A component's largest product in its cell is at the cell's upper edge where the query is positive and at
        its lower edge where it is negative: a sum over cells times query, and a constant for each query.  The sum
        is taken in single precision, and what that can round away is added.
        """
        weight = queries * self.width
        constant = queries @ self.low + np.maximum(queries, 0) @ (self.width - 1)
        # Each of the products and partial sums is off by at most 2**-24 of the sum of all magnitudes.
        slack = np.abs(weight).sum(1) * (CELLS - 1) * (queries.shape[1] + 2) * 2.0**-23 + 1e-6
        out = np.empty((len(queries), len(self.ids)))
        light = weight.astype(np.float32)
        for lo in range(0, len(self.ids), step):
            out[:, lo : lo + step] = light @ self.cells[lo : lo + step].astype(np.float32).T
        return out + (constant + slack)[:, None]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query id, vector id, score) of each query's k best; ties to the smaller id; its own row is left out."""
        bound = self.bounds(queries)
        out_q, out_v, out_s = [], [], []
        for q in range(len(queries)):
            b = np.where(self.ids == query_ids[q], -np.inf, bound[q])
            there = int(np.isfinite(b).sum())
            read, score = np.zeros(0, int), np.zeros(0, np.int64)
            take = min(max(2 * k, 16), there)
            while len(read) < there:
                top = np.argpartition(-b, take - 1)[:take]
                # Of what has the largest bounds, only what may still be among the best is read.
                worst = np.partition(score, -k)[-k] if len(score) >= k else -np.inf
                fresh = top[b[top] >= worst]
                read = np.concatenate([read, fresh])
                score = np.concatenate([score, self.vectors[fresh] @ queries[q].astype(np.int64)])
                self.reads += len(fresh)
                b[fresh] = -np.inf
                # An equal bound could hide a tie with a smaller id, so it must be read too.
                if len(fresh) < len(top) or len(score) >= k and np.partition(score, -k)[-k] > b.max():
                    break
                take = min(2 * take, there - len(read))
            best = np.lexsort((self.ids[read], -score))[:k]
            out_q.append(np.full(len(best), query_ids[q]))
            out_v.append(self.ids[read[best]])
            out_s.append(score[best])
        none = np.zeros(0)
        return tuple(np.concatenate(x or [none]).astype(np.int64) for x in (out_q, out_v, out_s))


def vectors_of(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: which of the lists have it, and those as a matrix."""
    size = np.asarray(column.value_lengths())
    end = np.cumsum(size)
    flat = np.asarray(column.flatten(), np.int64)
    out = {}
    for d in np.unique(size).tolist():
        pick = np.flatnonzero(size == d)
        out[d] = (pick, flat[(end[pick] - d)[:, None] + np.arange(d)])
    return out


def smallest_of_each(ids: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows that repeat an id, the smallest vector."""
    if len(np.unique(ids)) == len(ids):
        return ids, vectors
    order = np.lexsort((*vectors.T[::-1], ids))
    first = np.ones(len(ids), bool)
    first[1:] = ids[order][1:] != ids[order][:-1]
    return ids[order[first]], vectors[order[first]]


def integer_vector(vec: Column, scale: int) -> Column:
    """floor(scale * x) of every component in double; null if the vector, a component or a value isn't usable."""
    ok = vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(F.coalesce(ok, F.lit(False)), F.transform(vec, lambda x: F.floor(x.cast("double") * scale)))


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 1024, block_rows: int = 8192, query_rows: int = 1024) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's ``k`` largest integer inner products over ``vectors``.

    ``queries`` has the same columns as ``vectors``; a query's own id is no candidate.  Ties go to the smaller
    id.  Vectors that are null, hold null or non-finite components, or differ in length from a query take no
    part with it; with repeated ids the smallest vector of each length counts; null ids take no part.  Empty
    tables give no rows.  Other columns are ignored.  Scores must stay below 2**53.

    Vectors are dealt into blocks of about ``block_rows`` by a hash of the id.  Packed blocks of queries are
    sent to every vector block, so a task holds one vector block and streams the queries past it; only
    ``k`` rows per query and block are shuffled on.
    """
    bounded_batches(vectors.sparkSession)

    def whole(df: DataFrame) -> DataFrame:
        return df.select(F.col(id_col).cast("long").alias("id"), integer_vector(F.col(vec_col), scale).alias("v")).filter("id is not null and v is not null")

    blocks = max(1, math.ceil(vectors.count() / block_rows))
    base = whole(vectors).select(F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("kind"), F.col("id").alias("part"), F.array("id").alias("ids"), F.array("v").alias("vs"))
    n_parts = max(1, math.ceil(queries.count() / query_rows))
    asked = whole(queries).groupBy("id", F.size("v").alias("n")).agg(F.min("v").alias("v")).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(n_parts)))
    packed = asked.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("id", "v"))).alias("q"))
    sent = packed.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("kind"), "part", F.col("q.id").alias("ids"), F.col("q.v").alias("vs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, files = None, [], {}

        def close() -> dict[int, ApproximationFile]:
            """One file for each length of vectors."""
            out = {}
            for d in {d for d, _, _ in held}:
                ids, vecs = (np.concatenate([x[k] for x in held if x[0] == d]) for k in (1, 2))
                out[d] = ApproximationFile(*smallest_of_each(ids, vecs))
            return out

        for b in batches:
            keys = np.stack([np.array(b.column(k)).astype(np.int64) for k in (0, 1)], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cut, cut[1:]):
                if lo == hi:
                    continue
                if keys[lo, 0] != at:
                    at, held, files = keys[lo, 0], [], None
                part = b.slice(lo, hi - lo)
                ids, found = np.asarray(part.column(3).flatten(), np.int64), vectors_of(part.column(4).flatten())
                if keys[lo, 1] == 0:
                    held += [(d, ids[pick], vecs) for d, (pick, vecs) in found.items()]
                    continue
                if files is None:
                    files = close()
                for d in set(found) & set(files):
                    pick, vecs = found[d]
                    for k_ in range(0, len(pick), 256):
                        q, v, s = files[d].search(ids[pick[k_ : k_ + 256]], vecs[k_ : k_ + 256].astype(float), k)
                        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(v), pa.array(s)], ["query_id", "vec_id", "score"])

    dealt = base.unionByName(sent).repartition("block").sortWithinPartitions("block", "kind", "part")
    found = dealt.mapInArrow(run, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
