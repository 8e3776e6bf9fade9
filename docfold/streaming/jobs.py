"""Streaming jobs and their batch twins: the same function runs on a stream and on a static table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.history import upsert_votes
from ..sources.buckets import BucketTable
from .windows import stream_sliding_count

def rolling_quota(messages: DataFrame, late: str = "1 hour") -> DataFrame:
    """R2: user messages per user in sliding windows of 24 hours every hour (an exact count for any instant is A4)."""
    rows = messages.filter("role = 'user'")
    if messages.isStreaming:
        counted = stream_sliding_count(rows, "user_id", "ts", 24, late).select("user_id", F.col("start").alias("window_start"), (F.col("start") + F.expr("interval 24 hours")).alias("window_end"), F.col("count").alias("messages"))
    else:
        counted = rows.groupBy("user_id", F.window("ts", "24 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("messages")).select("user_id", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "messages")
    return counted.withColumn("over_limit", F.col("messages") > 100)


def cache_sessions(writes: DataFrame, late: str = "1 hour") -> DataFrame:
    """Life of a cache entry: writes less than an hour apart; hits are the writes in it."""
    rows = writes.withWatermark("ts", late) if writes.isStreaming else writes
    return rows.groupBy("user_id", "query_hash", F.session_window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("hit_count")).select("user_id", "query_hash", F.col("w.start").alias("created_at"), F.col("w.end").alias("expires_at"), "hit_count")


def daily_search_stats(stats: DataFrame, late: str = "1 hour") -> DataFrame:
    """Per user and day, mean time, searches, mean results."""
    rows = stats.withWatermark("ts", late) if stats.isStreaming else stats
    return rows.groupBy("user_id", F.window("ts", "1 day").alias("w")).agg(F.avg("execution_time_ms").alias("avg_ms"), F.count(F.lit(1)).alias("searches"), F.avg("result_count").alias("avg_results")).select("user_id", F.col("w.start").alias("day"), "avg_ms", "searches", "avg_results")


def dedupe_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each event once; replays within the watermark are dropped."""
    if events.isStreaming:
        return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there, batch by batch."""
    df.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


VOTES = "chat_id long, message_id long, is_upvoted boolean, ts timestamp_ntz"


def vote_table(spark: SparkSession, path: str, bucket_rows: int = 1_000_000) -> BucketTable:
    """The votes that :func:`stream_votes` keeps: ``vote_table(spark, path).read()`` is the table as last published."""
    return BucketTable(spark, path, VOTES, "chat_id", bucket_rows)


def stream_votes(votes: DataFrame, table: BucketTable, checkpoint: str) -> StreamingQuery:
    """The latest vote per message, in a table by chat.

    A batch merges the folders that its chats fall into and publishes them under its number (:class:`BucketTable`), so
    the table holds each vote once, and a batch that runs again changes nothing, wherever it had stopped.
    """

    def merge(batch: DataFrame, number: int) -> None:
        table.merge(batch, upsert_votes, number)

    return votes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_ingest(spark: SparkSession, folder: str, out: str, checkpoint: str, profile: str = "plain", chunk: Callable[[DataFrame], DataFrame] | None = None, settle: float = 2.0) -> StreamingQuery:
    """New files are validated, extracted and chunked; texts, chunks and rejects are appended.

    ``chunk`` makes ``id, chunk_index, content, ...`` from ``id, text``; by default texts are split recursively by
    ``profile``.  A batch that runs again replaces its own folders.  Files are taken ``settle`` seconds after their
    last change; those beyond the size limit are refused unread, those without a byte as empty.
    """
    from ..operators.chunking import chunk_recursive
    from ..sources import uploads
    from ..sources.files import MB, extract_text, file_type, validate_files

    cut = chunk or (lambda texts: chunk_recursive(texts, profile))
    uploads.register(spark)
    files = spark.readStream.format("uploads").options(settle=str(settle), maxBytes=str(15 * MB)).load(folder)
    rows = files.select("name", file_type("name").alias("file_type"), "size", "content")

    def ingest(batch: DataFrame, number: int) -> None:
        checked = validate_files(batch)
        texts = extract_text(checked.filter("reason is null")).select("name", "text", "error")
        # Each file is read and extracted once; both outputs come from what is set down.
        told = texts.unionByName(checked.filter("reason is not null").select("name", F.lit(None).cast("string").alias("text"), F.col("reason").alias("error")))
        told.write.mode("overwrite").parquet(f"{out}/texts/batch={number}")
        told = spark.read.schema("name string, text string, error string").parquet(f"{out}/texts/batch={number}")
        cut(told.filter("error is null and text <> ''").select(F.col("name").alias("id"), "text")).write.mode("overwrite").parquet(f"{out}/chunks/batch={number}")
        bad = told.filter("error is not null or text = ''").select("name", F.coalesce("error", F.lit("No text content found")).alias("reason"))
        bad.write.mode("overwrite").parquet(f"{out}/rejects/batch={number}")

    return rows.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
