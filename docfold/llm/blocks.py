"""Blocks of documents and hash ranges: tasks ask about hashes, and the range that owns a hash answers.

Documents are dealt into blocks of bounded size by a hash of id and text (and row
number, if rows repeat).  A block asks each hash range about its
own hashes with one packed row, and gets one packed row back whose entries follow the order of the question.
So the corpus-wide exchange is compact, and a hash that is everywhere costs a range one entry per block.
"""

from __future__ import annotations

import math

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def with_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int, range_bytes: int, carry: tuple[str, ...] = ()) -> tuple[DataFrame, int, int]:
    """``block, doc_id, text`` and ``carried`` (a struct of other columns), how many blocks, and how many hash ranges.

    Rows count 64 bytes besides their texts, and null text counts as empty.  A range answers what is asked about
    ``range_bytes`` of text, so neither blocks nor ranges grow with the corpus.  Rows that share an id are spread
    over blocks by their texts; where rows repeat both, the input is written once with row numbers, and those
    spread them.  So every evaluation puts a row in the same block.
    """
    carried = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("int")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), carried.alias("carried"))
    alike = rows.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text") + 64).alias("bytes"))
    total, most = (x or 0 for x in alike.agg(F.sum("bytes"), F.max("n")).first())
    n, ranges = (max(1, math.ceil(total / x)) for x in (block_bytes, range_bytes))
    by = ["doc_id", "text"]
    if most > 1:
        rows = materialize(rows.withColumn("number", F.monotonically_increasing_id()))
        by.append("number")
    return rows.select(F.pmod(F.xxhash64(*by), F.lit(n)).alias("block"), "doc_id", "text", "carried"), n, ranges


def range_of(hashes: np.ndarray, ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(33)) % np.uint64(ranges)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length as one compressed blob; byte planes are kept apart."""
    out = []
    for a in arrays:
        planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T
        out.append(np.ascontiguousarray(planes).tobytes())
    return zstandard.ZstdCompressor(1).compress(b"".join(out))


def unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    body = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    sizes = [np.dtype(t).itemsize for t in types]
    n = len(body) // sum(sizes)
    out, at = [], 0
    for t, size in zip(types, sizes):
        part = body[at : at + n * size].reshape(size, n)
        out.append(np.ascontiguousarray(part.T).view(t).reshape(-1))
        at += n * size
    return out
