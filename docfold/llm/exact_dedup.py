"""Exact deduplication: group by a 128-bit content hash, then compare bytes inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", hash_fn: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Rows are grouped by the MD5 of their text (``hash_fn``); the smallest (``keep="max"``: largest) id of a
    group stays.  Each row's bytes are compared with those of the row that stays, and rows that differ (a hash
    collision) form groups by their whole text.  The hash join that carries the comparison has one row per
    group on its other side, so a group of any size can be split among tasks.

    Null text counts as empty.  Repeated rows each count in ``group_size`` and share ``kept``; null ids lose
    against any other id and are kept only if all of a group's ids are null.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    best = F.min if keep == "min" else F.max
    rows = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("h", hash_fn("text"))
    groups = rows.groupBy("h").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    repeated = groups.filter("group_size > 1").select("h", "keep_id")
    # The text that stays, of groups with several rows only.
    stays = (
        rows.alias("r")
        .join(repeated.alias("g"), (F.col("r.h") == F.col("g.h")) & F.col("r.doc_id").eqNullSafe(F.col("g.keep_id")))
        .groupBy(F.col("r.h").alias("h"))
        .agg(F.min("r.text").alias("keep_text"))
    )
    told = materialize(groups.join(stays, "h", "left"))
    compared = materialize(
        rows.join(told, "h").select(
            "doc_id", "h", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), (F.col("keep_text").isNull() | (F.col("keep_text") == F.col("text"))).alias("same")
        )
    )
    if compared.filter("not same").isEmpty():
        return compared.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    # Only hashes that more than one text shares are grouped again, by their bytes.
    shared = compared.filter("not same").select("h").distinct()
    collided = rows.join(shared, "h", "left_semi")
    by_text = collided.groupBy("text").agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    again = collided.join(by_text, "text").select("doc_id", "keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"))
    rest = compared.join(shared, "h", "left_anti").select("doc_id", "keep_id", "group_size", "text_sha256")
    return rest.unionByName(again).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps; of rows that repeat id and text, one."""
    kept = exact_dedup(docs, id_col, text_col, keep).filter("kept").groupBy(F.col("doc_id").alias("_stays"), F.col("text_sha256").alias("_sha")).agg(F.count(F.lit(1)).alias("_rows"))
    stays = materialize(kept)
    same = docs[id_col].eqNullSafe(stays["_stays"]) & (F.sha2(F.coalesce(docs[text_col], F.lit("")), 256) == stays["_sha"])
    out = docs.join(stays, same, "left_semi")
    # Whole texts are shuffled once more only where a row is repeated.
    return out if stays.filter("_rows > 1").isEmpty() else out.dropDuplicates([id_col, text_col])
