"""Line dedup: lines that several documents share stay in one of them only."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Stripped from both ends of a line for its key.
WHITE = b" \t\n\x0b\x0c\r"


def line_key(line: bytes) -> bytes:
    """The normalised line: white space at both ends goes, A-Z become a-z, all else stays."""
    return line.strip(WHITE).lower()


def keyed_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """``doc_id, row, pos, key``: a row for each line whose key has ``min_chars`` code points or more.

    ``key`` is the MD5 of the normalised line, ``row`` a hash of the whole text, which tells rows of one id apart.
    Lower-casing A-Z alone is a byte operation in Python and a look-up per character in SQL, so lines are keyed in
    Arrow batches; lines themselves don't travel.
    """
    bounded_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pos, keys = [], [], []
            for i, body in enumerate(b.column("text")):
                for n, line in enumerate(body.as_py().split(b"\n")):
                    key = line_key(line)
                    # A code point has at most 4 bytes.
                    if len(key) >= 4 * min_chars or len(key.decode("utf-8", "replace")) >= min_chars:
                        at.append(i)
                        pos.append(n)
                        keys.append(hashlib.md5(key).digest())
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("row").take(take), pa.array(pos, pa.int32()), pa.array(keys, pa.binary())], ["doc_id", "row", "pos", "key"])

    return rows.mapInArrow(run, "doc_id long, row long, pos int, key binary")


def without(lines: Column, dropped: Column) -> Column:
    """``lines`` without those at the ascending places ``dropped``, joined: slices between them, in linear time."""
    starts, ends = F.concat(F.array(F.lit(-1)), dropped), F.concat(dropped, F.array(F.size(lines)))
    return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 2, b - a - 1))), "\n")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2) -> DataFrame:
    """One row per input row: ``doc_id, n_lines, dropped, kept``.

    Texts are split at ``\\n``.  A line's key is the line without white space at both ends and with A-Z in lower case.
    Keys of at least ``min_chars`` code points that ``min_docs`` or more documents hold lose all their lines, except
    those in the document with the smallest id that holds them.  ``dropped`` has the places (from 0) of the lines that
    go, in order, and ``kept`` is the rest, joined by ``\\n``.

    Keys are grouped by 128-bit hash.  Holders are made distinct before they are counted, so a line that is everywhere
    is pre-aggregated; in the join that finds the lines to drop each key has one row on the other side, so a frequent
    key can be split among tasks.  Texts are shuffled once, to meet their dropped places.

    Null or empty text is one empty line.  Rows that share an id are one document, whose lines all stay or go, and each
    comes back with its own lines; null ids are one document that keeps a line only if no other holds it.  An empty
    table gives no rows.  Other columns are ignored, whatever their names.
    """
    lines = keyed_lines(docs, id_col, text_col, min_chars)
    held = lines.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper")).filter(F.col("n") >= min_docs).select("key", "keeper")
    gone = lines.join(held, "key").filter(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    places = gone.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).agg(F.array_sort(F.collect_set("pos")).alias("dropped"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row"))
    met = rows.join(places, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    cut = met.select("doc_id", "text", "dropped", F.split("text", "\n", -1).alias("lines"))
    return cut.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"),
        F.when(F.col("dropped").isNull(), F.col("text")).otherwise(without(F.col("lines"), F.col("dropped"))).alias("kept"),
    )
