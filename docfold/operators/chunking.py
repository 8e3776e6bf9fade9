"""Chunking: documents to ordered chunks, document records, and comparison of chunkings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.batches import bounded_batches
from ..functions.text import file_title, summarize
from ..sources.files import file_type


def fixed_windows(text: Column, size: int = 1000, overlap: int = 200) -> Column:
    """Array of windows that start every ``size - overlap`` characters; the last reaches the end."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size is required")
    step = size - overlap
    n = F.when(F.length(text) <= size, 1).otherwise(1 + F.ceil((F.length(text) - size) / step)).cast("int")
    windows = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(text, i * step + 1, F.lit(size)))
    return F.when(F.length(text) > 0, windows).otherwise(F.array().cast("array<string>"))


def chunk_fixed(df: DataFrame, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``id, chunk_index, content`` from ``id, text``; empty texts have no chunk."""
    return df.select("id", F.posexplode(fixed_windows(F.col("text"), size, overlap)).alias("chunk_index", "content"))


@dataclass(frozen=True)
class Profile:
    """How to split: target size, overlap, separators from coarse to fine, and whether they stay."""

    size: int
    overlap: int
    separators: tuple[str, ...]
    keep: bool


# Fixed values.
PROFILES = {
    "rag": Profile(2400, 400, ("\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", "! ", "? ", "; ", ":", ", ", " ", ""), True),
    "plain": Profile(1000, 200, ("\n\n", "\n", " ", ""), False),
    "book": Profile(1000, 200, ("\n\n\n", "\n\n", "\n", ". ", "! ", "? ", "; ", ", ", " ", ""), False),
}


def recursive_split(text: str, p: Profile, length: Callable[[str], int] = len) -> list[str]:
    """Pieces of at most ``p.size`` where a separator allows it, with up to ``p.overlap`` carried over."""
    out: list[str] = []

    def merge(parts: list[str], glue: str) -> Iterator[str]:
        window: list[str] = []
        total = 0
        for part in parts:
            n = length(part)
            if window and total + n + len(glue) > p.size:
                yield glue.join(window).strip()
                while window and (total > p.overlap or total + n + len(glue) > p.size):
                    total -= length(window.pop(0)) + (len(glue) if window else 0)
            total += n + (len(glue) if window else 0)
            window.append(part)
        if window:
            yield glue.join(window).strip()

    def split(body: str, separators: tuple[str, ...]) -> None:
        at = next((i for i, s in enumerate(separators) if s == "" or s in body), len(separators) - 1)
        sep, finer = separators[at], separators[at + 1 :]
        parts = list(body) if sep == "" else body.split(sep)
        if p.keep and sep:
            parts = [parts[0], *(sep + x for x in parts[1:])]
        glue = "" if p.keep else sep
        small: list[str] = []
        for part in filter(None, parts):
            if length(part) < p.size:
                small.append(part)
                continue
            out.extend(merge(small, glue))
            small = []
            if finer:
                split(part, finer)
            else:
                out.append(part)
        out.extend(merge(small, glue))

    split(text, p.separators)
    return [x for x in out if x]


def chunk_recursive(df: DataFrame, profile: str | Profile = "rag", length: Callable[[str], int] = len) -> DataFrame:
    """``id, chunk_index, content, metadata`` from ``id, text``, by recursive splitting.

    ``length`` measures pieces against the profile's size and overlap: characters, or tokens of a tokenizer.
    The Arrow helper sees the text column alone, in bounded batches, and returns arrays; rows multiply after it.
    """
    bounded_batches(df.sparkSession)
    p = PROFILES[profile] if isinstance(profile, str) else profile

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: recursive_split(t or "", p, length))

    n = F.length("content")
    return df.select("id", F.posexplode(pieces("text")).alias("chunk_index", "content")).withColumn("metadata", F.struct(F.lit(0).alias("start_char"), n.alias("end_char"), F.ceil(n / 4).alias("tokens")))


def document_record(df: DataFrame, chunks: Callable[[Column], Column] = fixed_windows) -> DataFrame:
    """One record per document of ``id, name, text``, from the chunk array, before it is exploded.

    ``file_type`` comes from the name; ``file_size`` is the column of that name, else the text's bytes.
    """
    size = F.col("file_size").cast("long") if "file_size" in df.columns else F.octet_length("text").cast("long")
    c = df.withColumn("c", chunks(F.col("text")))
    total = F.aggregate("c", F.lit(0).cast("long"), lambda n, x: n + F.length(x))
    return c.select(
        "id", file_title("name").alias("title"), summarize("text").alias("summary"), F.get("c", F.lit(0)).alias("first_page_content"), F.size("c").cast("long").alias("chunk_count"),
        F.when(F.size("c") > 0, F.floor(total / F.size("c") + 0.5)).alias("avg_chunk_size"), size.alias("file_size"), file_type("name").alias("file_type"),
    )


def compare_chunkings(a: DataFrame, b: DataFrame) -> DataFrame:
    """C4: per document, count, mean and variance of two chunkings, differences, and which is more even."""

    def stats(df: DataFrame, p: str) -> DataFrame:
        n = F.length("content").cast("double")
        return df.groupBy("id").agg(F.count(F.lit(1)).alias(f"{p}_count"), F.avg(n).alias(f"{p}_mean"), F.var_pop(n).alias(f"{p}_variance"))

    both = stats(a, "a").join(stats(b, "b"), "id")
    d_n, d_mean, d_var = (F.col(f"b_{k}") - F.col(f"a_{k}") for k in ("count", "mean", "variance"))
    best = F.when((F.abs(d_n) < 2) & (F.abs(d_mean) < 100), "equivalent").when(d_var < 0, "b").otherwise("a")
    return both.withColumn("recommendation", best)
