"""Embedding whitening: an exact covariance from bit-sliced cross-products, and projections on its components."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Entries (rows times dimensions) of one bit-sliced block.
BLOCK_ENTRIES = 1 << 19
#: Bytes of one exact sum in transport.
WIDE = 24
#: Entries whose whole number is beyond this count as this.
BOUND = float(1 << 62)


def whole_vectors(batch: pa.RecordBatch, scale: int, shift: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The rows that take part, and per length of vector their (row numbers, whole numbers as int64 rows)."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = np.where(np.asarray(v.is_valid()), np.asarray(v.value_lengths().fill_null(0)), 0)
    flat = v.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    begin = np.cumsum(sizes) - sizes
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
    good = np.flatnonzero((sizes > 0) & (bad[begin + sizes] == bad[begin]))
    out = []
    for d in np.unique(sizes[good]).tolist():
        rows = good[sizes[good] == d]
        entries = flat[begin[rows][:, None] + np.arange(d)]
        out.append((rows, np.clip(np.floor(scale * entries), -BOUND, BOUND).astype(np.int64) + shift))
    return good, out


@dataclass
class Planes:
    """How entries of each dimension are cut into bits: their least values, and for each plane its dimension and bit."""

    least: np.ndarray
    dims: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, least: np.ndarray, most: np.ndarray) -> Planes:
        width = [max(1, (int(hi) - int(lo)).bit_length()) for lo, hi in zip(least, most)]
        return cls(least, np.repeat(np.arange(len(width)), width), np.concatenate([np.arange(w) for w in width]))

    def pack(self, x: np.ndarray) -> np.ndarray:
        """Planes x words: bit ``bits[p]`` of dimension ``dims[p]``, shifted to start at 0, over all rows."""
        y = (x - self.least).astype(np.uint64)
        body = np.zeros((len(self.dims), -(-len(x) // 64) * 8), np.uint8)
        for p, (d, b) in enumerate(zip(self.dims.tolist(), self.bits.tolist())):
            bits = np.packbits(((y[:, d] >> np.uint64(b)) & np.uint64(1)).astype(np.uint8))
            body[p, : len(bits)] = bits
        return body.view(np.uint64)

    def scatter(self, words: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact sums of the shifted entries, and of the products of each pair (upper triangle), from popcounts.

        A product of two planes is the count of rows that have both bits, and weighs 2 to the sum of both bits' places.
        """
        n, first = len(self.least), np.searchsorted(self.dims, np.arange(len(self.least)))
        top = int(self.bits.max())
        kind = np.int64 if 2 * top + 2 + rows.bit_length() <= 62 else object
        weight = np.array([1 << b for b in self.bits.tolist()], kind)
        sums = np.add.reduceat(np.bitwise_count(words).sum(1, dtype=np.int64).astype(kind) * weight, first)
        products = np.zeros((n, n), kind)
        for p, d in enumerate(self.dims.tolist()):
            lo = int(first[d])
            both = np.bitwise_count(words[lo:] & words[p]).sum(1, dtype=np.int64).astype(kind) * weight[lo:]
            products[d, d:] += np.add.reduceat(both, first[d:] - lo) * weight[p]
        return sums.astype(object), products.astype(object)


@dataclass
class Whitening:
    """A fit: rows, exact sums of the whole numbers, and the directions that entries are projected on."""

    n: int
    sums: list[int]
    scale: int
    shift: int
    directions: np.ndarray  # dimensions x components: unit eigenvectors over the roots of their eigenvalues
    explained: np.ndarray
    spread: int  # n times an entry differs from its sum by that at most
    error: float = 0.0

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n*x - S, exactly: in 64 bits where they suffice for every entry, else in Python's whole numbers."""
        kind = np.int64 if self.spread.bit_length() <= 62 else object
        return x.astype(kind) * self.n - np.array(self.sums, kind)

    def project(self, deviations: np.ndarray) -> np.ndarray:
        return (deviations.astype(np.float64) / self.n) @ self.directions


def _vectors(df: DataFrame, vector_col: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.select(F.col(vector_col).cast("array<double>").alias("v"))


def _extent(df: DataFrame, vector_col: str, scale: int, shift: int) -> tuple[int, np.ndarray, np.ndarray] | None:
    """Rows of the most frequent length (of equally frequent ones the longest), least and greatest entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, tuple[int, np.ndarray, np.ndarray]] = {}
        for b in batches:
            for _, x in whole_vectors(b, scale, shift)[1]:
                n, lo, hi = seen.get(x.shape[1], (0, x[0], x[0]))
                seen[x.shape[1]] = (n + len(x), np.minimum(lo, x.min(0)), np.maximum(hi, x.max(0)))
        for d, (n, lo, hi) in seen.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d, d)), pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(lo), pa.array(hi)], ["dims", "d", "n", "lo", "hi"])

    per = _vectors(df, vector_col).mapInArrow(run, "dims long, d long, n long, lo long, hi long").groupBy("dims", "d").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    found = per.groupBy("dims").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "lo", "hi"))).alias("each")).orderBy(F.desc("n"), F.desc("dims")).first()
    if found is None:
        return None
    return found.n, np.array([r.lo for r in found.each], np.int64), np.array([r.hi for r in found.each], np.int64)


def _wide(values: np.ndarray) -> bytes:
    return b"".join(int(v).to_bytes(WIDE, "big") for v in values)


def _narrow(body: bytes) -> np.ndarray:
    return np.array([int.from_bytes(body[i : i + WIDE], "big") for i in range(0, len(body), WIDE)], object)


def _scatter(df: DataFrame, vector_col: str, scale: int, shift: int, planes: Planes) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums and cross-products of the shifted entries of all rows of the planes' length.

    A task slices its rows in blocks and gives out one row of sums per dimension at its end; these meet by dimension
    and are added as they stream in, so nothing but one dimension's row is held, and the driver gets the triangle.
    """
    n = len(planes.least)
    block = max(64, BLOCK_ENTRIES // n // 64 * 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, products = np.zeros(n, object), np.zeros((n, n), object)
        held: list[np.ndarray] = []

        def flush() -> None:
            nonlocal sums, products
            x = np.concatenate(held)
            for lo in range(0, len(x), block):
                part = x[lo : lo + block]
                s, t = planes.scatter(planes.pack(part), len(part))
                sums, products = sums + s, products + t
            held.clear()

        for b in batches:
            held += [x for _, x in whole_vectors(b, scale, shift)[1] if x.shape[1] == n]
            if sum(map(len, held)) >= block:
                flush()
        if held:
            flush()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array([_wide(np.append(sums[d], products[d, d:])) for d in range(n)], pa.binary())], ["d", "body"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for d, body in zip(b.column("d").to_pylist(), b.column("body")):
                row = _narrow(body.as_py())
                total[d] = total[d] + row if d in total else row
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([_wide(v) for v in total.values()], pa.binary())], ["d", "body"])

    parts = _vectors(df, vector_col).mapInArrow(run, "d long, body binary")
    sums, products = np.zeros(n, object), np.zeros((n, n), object)
    for r in parts.repartition("d").mapInArrow(add, "d long, body binary").collect():
        row = _narrow(bytes(r.body))
        sums[r.d], products[r.d, r.d :] = row[0], row[1:]
    return sums, np.triu(products) + np.triu(products, 1).T


def fit_whitening(df: DataFrame, vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> Whitening | None:
    """Fits on every usable row of ``df``; ``None`` where there is none.

    An entry ``c`` becomes the whole number ``floor(scale * c) + shift``.  Cross-products are exact: each dimension is
    shifted to start at 0 and cut into bit planes, planes are packed across rows into 64-bit words, and popcounts of
    the AND of two planes are added with their weights.  The covariance is centred in whole numbers
    (``n * sum(xy) - sum(x) * sum(y)``), rounded once to double, and handed to ``eigh``.  The driver holds a matrix of
    dimensions x dimensions, whatever the number of rows.
    """
    extent = _extent(df, vector_col, scale, shift)
    if extent is None:
        return None
    n, least, most = extent
    shifted, products = _scatter(df, vector_col, scale, shift, Planes.of(least, most))
    centred = n * products - shifted[:, None] * shifted[None, :]
    covariance = np.array([[float(Fraction(int(c), n * n)) for c in row] for row in centred])
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:components]
    e, u = values[order], vectors[:, order]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(len(order))])
    trace = float(Fraction(int(np.trace(centred)), n * n))
    # A direction along which the rows don't differ has an eigenvalue of rounding errors.
    real = e > len(values) * np.finfo(float).eps * max(float(values[-1]), 0.0)
    directions = np.where(real, u / np.sqrt(np.where(real, e, 1.0)), 0.0)
    sums = [int(s) + n * int(lo) for s, lo in zip(shifted, least)]
    spread = max(n * max(int(hi), -int(lo), 1) + abs(s) for s, lo, hi in zip(sums, least, most))
    fit = Whitening(n, sums, scale, shift, directions, np.where(real, e / trace if trace else 0.0, 0.0), spread)
    fit.error = _identity_error(df, vector_col, fit, real)
    return fit


def _identity_error(df: DataFrame, vector_col: str, fit: Whitening, real: np.ndarray) -> float:
    """Largest absolute entry of the whitened rows' covariance minus the identity, over components with variance."""
    k, dims = fit.directions.shape[1], len(fit.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for b in batches:
            for _, x in whole_vectors(b, fit.scale, fit.shift)[1]:
                if x.shape[1] == dims:
                    w = np.column_stack([fit.project(fit.deviations(x)), np.ones(len(x))])
                    total += w.T @ w
        a, b = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(a.ravel()), pa.array(b.ravel()), pa.array(total.ravel())], ["a", "b", "s"])

    sums = np.zeros((k + 1, k + 1))
    for r in _vectors(df, vector_col).mapInArrow(run, "a long, b long, s double").groupBy("a", "b").agg(F.sum("s").alias("s")).collect():
        sums[r.a, r.b] = r.s
    mean = sums[:k, k] / fit.n
    error = np.abs(sums[:k, :k] / fit.n - np.outer(mean, mean) - np.eye(k))[np.ix_(real, real)]
    return float(error.max()) if error.size else 0.0


def whiten(df: DataFrame, fit: Whitening | None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n, deviation, whitened array<double>`` of each usable row; see :func:`whitened_components`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, x in whole_vectors(b, fit.scale, fit.shift)[1]:
                if x.shape[1] != len(fit.sums):
                    continue
                z = fit.deviations(x)
                # The squares' sum may need more than 64 bits.
                small = z.dtype != object and 2 * int(np.abs(z).max()).bit_length() + x.shape[1].bit_length() <= 62
                squares = (z * z).sum(1).tolist() if small else [sum(v * v for v in row) for row in z.tolist()]
                w = fit.project(z)
                held = pa.ListArray.from_arrays(pa.array(np.arange(0, w.size + 1, w.shape[1]), pa.int32()), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(rows)), pa.array(np.full(len(rows), fit.n)), pa.array([str(s) for s in squares]), held], ["vec_id", "n", "deviation", "whitened"])

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    return (rows if fit is not None else rows.limit(0)).mapInArrow(run, "vec_id long, n long, deviation string, whitened array<double>").withColumn("deviation", F.expr("try_cast(deviation as decimal(38,0))"))


def whitened_components(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """One row per usable row and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Fits (:func:`fit_whitening`) and projects on all rows.  Components are unit eigenvectors of the covariance, numbered
    from 1 by falling eigenvalue, with the sign that makes their largest entry positive; there are as many as dimensions
    if these are fewer.  ``deviation`` is the exact sum over dimensions of ``(n*x - S)**2`` (null beyond 38 digits),
    ``whitened`` the centred row along the component over the root of its eigenvalue, ``explained`` the eigenvalue's
    share of the trace, and ``identity_error`` is measured on the whitened rows.

    Rows whose vector is null or empty, or holds null or non-finite entries, take no part, and neither do rows of
    another length than the most frequent one (of equally frequent ones the longest).  Repeated rows and null ids count
    and come back like any other.  A component without variance (equal rows, or a single one) is 0 for all rows,
    explains 0, and isn't held against the identity.  Among equal eigenvalues ``eigh`` chooses the directions.
    A table without usable rows gives none.  Other columns are ignored, whatever their names.
    """
    fit = fit_whitening(df, vector_col, components, scale, shift)
    shares = [] if fit is None else fit.explained.tolist()
    rows = whiten(df, fit, id_col, vector_col).select("vec_id", "n", "deviation", F.posexplode("whitened").alias("_c", "whitened"))
    explained = F.get(F.array(*map(F.lit, shares)).cast("array<double>"), F.col("_c"))
    return rows.select("vec_id", (F.col("_c") + 1).alias("component"), "n", "deviation", "whitened", explained.alias("explained"), F.lit(0.0 if fit is None else fit.error).alias("identity_error"))
