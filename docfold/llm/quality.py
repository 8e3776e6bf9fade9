"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A text is a bag of hashed words, of byte-class bigrams and trigrams, and of binned measures of repetition, case
and line shape.  Terms are weighted and projected by a truncated SVD of a bounded labelled sample; the sample's vectors
are broadcast, every document takes exact cosine products with all of them in blocks, and its nearest
neighbours vote for their labels by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, mix, prefix_hashes, sample_ids, span_hashes, text_steps, word_spans

CLASSES = 40
PAIRS = CLASSES * CLASSES
TRIPLES = 2048
WORDS = 4096
BINS, MEASURES = 24, 8
TERMS = PAIRS + TRIPLES + WORDS + BINS * MEASURES
#: How much one measure's bin weighs against the text's n-grams.
MEASURE_WEIGHT = 0.35


def _classes() -> np.ndarray:
    out = np.full(256, 39, np.uint8)
    out[128:] = 38
    out[97:123], out[65:91], out[48:58], out[32], out[10] = 0, 1, 2, 3, 4
    marks = [b for b in range(33, 127) if out[b] == 39]
    for k, b in enumerate(marks):
        out[b] = 5 + k % 33
    return out


CLASS_OF = _classes()


def quality_terms(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Term counts of each row's whole text: rows x TERMS, float32."""
    rows = len(offsets) - 1
    out = np.zeros((rows, TERMS), np.float32)
    if not len(data):
        return out
    size = np.diff(offsets)
    at = np.repeat(np.arange(rows), size)
    c = CLASS_OF[data].astype(np.int64)
    pair = c[:-1] * CLASSES + c[1:]
    ok = at[:-1] == at[1:]
    out[:, :PAIRS] = np.bincount((at[:-1] * PAIRS + pair)[ok], minlength=rows * PAIRS).reshape(rows, PAIRS)
    if len(data) > 2:
        ok = at[:-2] == at[2:]
        triple = ((pair[:-1] * CLASSES + c[2:]) * 0x9E3779B1 >> 7) % TRIPLES
        out[:, PAIRS : PAIRS + TRIPLES] = np.bincount((at[:-2] * TRIPLES + triple)[ok], minlength=rows * TRIPLES).reshape(rows, TRIPLES)
    lengths = np.maximum(size, 1)[:, None]
    out[:, :PAIRS] = np.sqrt(out[:, :PAIRS] / lengths)
    out[:, PAIRS : PAIRS + TRIPLES] = np.sqrt(out[:, PAIRS : PAIRS + TRIPLES] / lengths)
    # Measures: distinct words, repeats of the word before, line repeats, case, marks, digits, word and line length.
    starts, ends, row = word_spans(data, offsets)
    h = mix(span_hashes(prefix_hashes(ascii_lower(data)), starts, ends))
    words = np.bincount(row, minlength=rows)
    bag = np.bincount(row * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=rows * WORDS).reshape(rows, WORDS)
    out[:, PAIRS + TRIPLES : PAIRS + TRIPLES + WORDS] = np.sqrt(bag / np.maximum(words, 1)[:, None])
    order = np.lexsort((h, row))
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    w = np.maximum(words, 1)
    distinct = np.bincount(row[order][fresh], minlength=rows)
    kinds = np.bincount(at * CLASSES + c, minlength=rows * CLASSES).reshape(rows, CLASSES) / lengths
    lines = np.bincount(at, weights=c == 4, minlength=rows)
    measures = [
        # A longer text repeats more words: the exponent evens that out.
        np.log(np.maximum(distinct, 1)) / np.log(np.maximum(words, 2)),
        np.bincount(row[again], minlength=rows) / w,
        kinds[:, 1] / np.maximum(kinds[:, 0] + kinds[:, 1], 1e-9),
        kinds[:, 5:38].sum(1) * 3,
        kinds[:, 2] * 4,
        size / w / 16,
        np.log1p(words) / 10,
        np.log1p(size / (lines + 1)) / 10,
    ]
    for k, x in enumerate(measures):
        b = np.minimum((np.clip(x, 0, 1) * BINS).astype(int), BINS - 1)
        base = PAIRS + TRIPLES + WORDS + k * BINS
        for d, share in ((-1, 0.5), (0, 1.0), (1, 0.5)):
            out[np.arange(rows), base + np.clip(b + d, 0, BINS - 1)] += MEASURE_WEIGHT * share
    out[size == 0] = 0
    return out


class QualityModel:
    """The projection, and the labelled vectors with the weight of each one's vote."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, vectors: np.ndarray, labels: np.ndarray, votes: np.ndarray, neighbours: int) -> None:
        self.mean, self.axes, self.vectors, self.labels, self.votes, self.neighbours = mean, axes, vectors, labels, votes, neighbours

    def project(self, terms: np.ndarray) -> np.ndarray:
        v = (terms - self.mean) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def score(self, terms: np.ndarray, block: int = 256, skip_self: bool = False) -> np.ndarray:
        """Share of label 1 among the nearest neighbours' votes; exact cosines with every labelled vector."""
        out = np.full(len(terms), 0.5)
        if not len(self.vectors):
            return out
        k = min(self.neighbours, len(self.vectors))
        for lo in range(0, len(terms), block):
            cos = self.project(terms[lo : lo + block]) @ self.vectors.T
            if skip_self:
                cos[np.arange(len(cos)), lo + np.arange(len(cos))] = -1
            near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
            weight = np.maximum(np.take_along_axis(cos, near, 1), 0) ** 8 * self.votes[near] + 1e-9
            out[lo : lo + block] = (weight * self.labels[near]).sum(1) / weight.sum(1)
        return out


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", n_per_class: int = 1500, dims: int = 48, neighbours: int = 15) -> QualityModel:
    """Fits on at most ``n_per_class`` labelled rows of each class, chosen by hash order; whole texts.

    Terms are counted in tasks; the driver gets ``2 * n_per_class`` vectors of TERMS floats at most (48 MB at
    the defaults, in half precision).  Rows without label or text take no part; without rows every score is 0.5.
    """
    bounded_batches(docs.sparkSession)
    some = None
    for label in (0, 1):
        part = sample_ids(labels.filter(F.col(label_col) == label), id_col, n_per_class).select(F.col(id_col).alias("doc_id"), F.lit(label).alias("label"))
        some = part if some is None else some.unionByName(part)
    rows = docs.filter(F.col(text_col) != "").select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_steps(b.column("text")):
                x = quality_terms(data, offsets).astype(np.float16)
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), b.column("label").slice(lo, hi - lo), pa.array([r.tobytes() for r in x], pa.binary())], ["doc_id", "label", "terms"])

    got = rows.mapInArrow(count, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, terms binary").orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * n_per_class).toArrow()
    y = np.array(got["label"].to_pylist(), float)
    x = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float16).reshape(-1, TERMS).astype(np.float32)
    if not len(y):
        return QualityModel(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y, neighbours)
    mean = x.mean(0)
    # Truncated SVD by subspace iteration from fixed random directions.
    centred = x - mean
    axes = np.random.default_rng(3).normal(size=(TERMS, dims + 10)).astype(np.float32)
    for _ in range(6):
        axes, _ = np.linalg.qr(centred.T @ (centred @ axes))
    _, _, turn = np.linalg.svd(centred @ axes, full_matrices=False)
    axes = np.ascontiguousarray((axes @ turn.T)[:, :dims], np.float32)
    share = np.array([max((y == k).sum(), 1) for k in (0, 1)])
    model = QualityModel(mean, axes, np.zeros((0, dims), np.float32), y, 1 / share[y.astype(int)] * share.min(), neighbours)
    model.vectors = model.project(x)
    return model


def score_quality(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1, higher: label 1 likelier) for each row, over its whole text.

    Null and empty texts score 0; repeated rows score alike; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [np.zeros(0)]
            for _, _, data, offsets in text_steps(b.column(1)):
                scores.append(np.where(np.diff(offsets) > 0, shared.value.score(quality_terms(data, offsets)), 0.0))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
