"""Statistics, search cache and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import user_type
from ..sources.buckets import BucketTable


#: What is kept of a document's chunks: everything that A1 and A2 are made of.
SUMS = "document_id long, chunk_count long, chars long, first_chunk_date timestamp_ntz, last_chunk_date timestamp_ntz"


def chunk_sums(chunks: DataFrame) -> DataFrame:
    """Lengths instead of texts, and one row per document before any join."""
    return chunks.select("document_id", F.length("content").alias("n"), "created_at").groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("n").alias("chars"), F.min("created_at").alias("first_chunk_date"), F.max("created_at").alias("last_chunk_date"))


def document_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A1: per document, chunk count, mean length and dates; 0 and nulls without chunks."""
    return stats_of_sums(docs, chunk_sums(chunks))


def stats_of_sums(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """A1 from sums per document, computed or kept up (:func:`refresh_sums`)."""
    j = docs.select(F.col("id").alias("document_id"), "user_id", "title", "file_type").join(sums, "document_id", "left")
    return j.select("document_id", "user_id", "title", "file_type", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), (F.col("chars") / F.col("chunk_count")).alias("avg_chunk_length"), "first_chunk_date", "last_chunk_date")


def knowledge_base_size(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A2: per user, documents, chunks, characters, rounded mean length, bytes of vectors."""
    return size_of_sums(docs, chunk_sums(chunks))


def size_of_sums(docs: DataFrame, sums: DataFrame) -> DataFrame:
    """A2 from sums per document."""
    j = docs.select(F.col("id").alias("document_id"), "user_id").join(sums, "document_id", "left").groupBy("user_id")
    n = F.coalesce(F.sum("chunk_count"), F.lit(0))
    return j.agg(F.countDistinct("document_id").alias("documents"), n.alias("chunks"), F.sum("chars").alias("characters"), F.floor(F.sum("chars") / F.sum("chunk_count") + 0.5).alias("avg_chunk_length"), (n * 1536 * 4).alias("vector_bytes"))


def refresh_sums(sums: BucketTable, inserted: DataFrame, deleted: DataFrame, chunks: BucketTable | DataFrame, number: int | None = None) -> bool:
    """Brings ``sums`` (of :data:`SUMS`, by document) up to date after chunks were inserted and deleted.

    ``inserted`` and ``deleted`` are rows of chunks (of deleted ones the content as it was), and ``chunks`` the table after
    both.  Counts and lengths are added and subtracted; a first or last date that went is looked up again, in the
    chunks of just those documents.  Documents without chunks leave.  Folders that no change falls into aren't read,
    and neither are chunks of documents that keep their dates.  Under a ``number`` that was merged before nothing happens.
    """
    plus, minus = chunk_sums(inserted), chunk_sums(deleted)
    names = ["chunk_count", "chars", "first_chunk_date", "last_chunk_date"]
    change = plus.select("document_id", *[F.col(c).alias(f"in_{c}") for c in names]).join(minus.select("document_id", *[F.col(c).alias(f"out_{c}") for c in names]), "document_id", "full")

    def how(held: DataFrame, delta: DataFrame) -> DataFrame:
        n = lambda c: F.coalesce(F.col(c), F.lit(0))
        j = held.join(delta, "document_id", "full").withColumns({c: n(c) + n(f"in_{c}") - n(f"out_{c}") for c in ("chunk_count", "chars")}).filter("chunk_count > 0")
        first, last = F.least("first_chunk_date", "in_first_chunk_date"), F.greatest("last_chunk_date", "in_last_chunk_date")
        lost = F.coalesce(F.col("out_first_chunk_date") <= first, F.lit(False)) | F.coalesce(F.col("out_last_chunk_date") >= last, F.lit(False))
        j = j.select("document_id", "chunk_count", "chars", first.alias("first_chunk_date"), last.alias("last_chunk_date"), lost.alias("lost"))
        gone = j.filter("lost").select("document_id")
        if gone.isEmpty():
            return j.drop("lost")
        left = (chunks.read_keys(gone) if isinstance(chunks, BucketTable) else chunks.join(gone, "document_id", "left_semi")).groupBy("document_id").agg(F.min("created_at").alias("_first"), F.max("created_at").alias("_last"))
        again = j.join(left, "document_id", "left")
        return again.select("document_id", "chunk_count", "chars", *[F.when(F.col("lost"), F.col(f"_{x}")).otherwise(F.col(f"{x}_chunk_date")).alias(f"{x}_chunk_date") for x in ("first", "last")])

    return sums.merge(change, how, number)


def change_chunks(chunks: BucketTable, inserted: DataFrame, deleted: DataFrame, number: int | None = None) -> bool:
    """The chunk table (by document) without the chunks of ``deleted(id, document_id)`` and with ``inserted``."""
    columns = inserted.columns
    change = inserted.withColumn("_new", F.lit(True)).unionByName(deleted.select("id", "document_id", F.lit(False).alias("_new")), allowMissingColumns=True)

    def how(held: DataFrame, delta: DataFrame) -> DataFrame:
        return held.join(delta.filter("not _new").select("id", "document_id"), ["id", "document_id"], "left_anti").select(*columns).unionByName(delta.filter("_new").select(*columns))

    return chunks.merge(change, how, number)


def table_counts(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """A3: documents and chunks per user, and of all (user null; also chunks without a document)."""
    d = docs.select(F.col("id").alias("document_id"), "user_id")
    n = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
    per = d.join(n, "document_id", "left").groupBy("user_id").agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))
    rows = docs.select(F.lit(1).alias("d"), F.lit(0).alias("c")).unionByName(chunks.select(F.lit(0).alias("d"), F.lit(1).alias("c")))
    whole = rows.agg(F.sum("d").alias("documents"), F.sum("c").alias("chunks")).select(F.lit(None).cast("long").alias("user_id"), "documents", "chunks")
    return per.unionByName(whole)


def message_count(messages: DataFrame, chats: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """A4: per user, user messages of the last hours; role and time are filtered before the join."""
    recent = messages.filter((F.col("role") == "user") & (F.col("created_at") >= now - F.expr(f"interval {hours} hours"))).groupBy("chat_id").count()
    return recent.join(chats.select(F.col("id").alias("chat_id"), "user_id"), "chat_id").groupBy("user_id").agg(F.sum("count").alias("messages"))


#: Messages a day.
QUOTA = {"guest": 20, "regular": 100}


def quota_status(users: DataFrame, messages: DataFrame, chats: DataFrame, now: Column, quota: dict[str, int] = QUOTA) -> DataFrame:
    """A5: each user's count against the limit of its type; exceeded when over it."""
    kind = user_type("email")
    top = F.when(kind == "guest", quota["guest"]).otherwise(quota["regular"])
    j = users.select(F.col("id").alias("user_id"), kind.alias("user_type"), top.alias("quota")).join(message_count(messages, chats, now), "user_id", "left")
    return j.withColumn("messages", F.coalesce("messages", F.lit(0))).withColumn("exceeded", F.col("messages") > F.col("quota"))


def search_summary_stats(stats: DataFrame, cache: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per user of the last days, mean time, searches, share of cached ones, mean result count."""
    recent = stats.filter(F.col("created_at") > now - F.expr(f"interval {days} days"))
    known = cache.select("user_id", "query_hash", F.lit(1).alias("hit")).distinct()
    g = recent.join(known, ["user_id", "query_hash"], "left").groupBy("user_id")
    return g.agg(F.avg("execution_time_ms").alias("avg_ms"), F.count(F.lit(1)).alias("searches"), (F.count("hit") * 100.0 / F.count(F.lit(1))).alias("cache_hit_rate"), F.avg("result_count").alias("avg_results"))


def group_chunks_by_document(chunks: DataFrame) -> DataFrame:
    """Per document, its chunks' ids in order and how many (a document has a bounded number of chunks)."""
    ids = F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "id"))), lambda x: x["id"].cast("string"))
    return chunks.groupBy("document_id").agg(F.array_join(ids, ",").alias("chunk_ids"), F.count(F.lit(1)).alias("chunks"))


def orphan_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """M6: chunks without a document."""
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_anti")


def drop_orphans(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    return chunks.join(docs.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def cache_merge(cache: DataFrame, writes: DataFrame) -> DataFrame:
    """M7: writes ``(user_id, query_hash, ts)`` merged into the cache: an hour's life from the last write, a hit each."""
    new = writes.groupBy("user_id", "query_hash").agg(F.max("ts").alias("_ts"), F.count(F.lit(1)).alias("_n"))
    j = cache.join(new, ["user_id", "query_hash"], "full")
    return j.select(
        "user_id", "query_hash", F.coalesce("_ts", "created_at").alias("created_at"), F.coalesce(F.col("_ts") + F.expr("interval 1 hour"), F.col("expires_at")).alias("expires_at"),
        (F.coalesce("hit_count", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("hit_count"),
    )


def cache_lookup(cache: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """M8: live entries that requests name; ``is_expired`` is therefore false."""
    return cache.filter(F.col("expires_at") > now).join(requests, ["user_id", "query_hash"], "left_semi").withColumn("is_expired", F.lit(False))


def cache_expire(cache: DataFrame, now: Column) -> DataFrame:
    """M9: entries whose time is past go; one that ends just now stays (but isn't served)."""
    return cache.filter(F.col("expires_at") >= now)


def maintenance(docs: DataFrame, chunks: DataFrame, cache: DataFrame, now: Column) -> DataFrame:
    """What one round of upkeep does: expired entries, orphans, and documents with statistics."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("task"), "n")
    return one(cache.filter(F.col("expires_at") < now), "expired_cache_entries").unionByName(one(orphan_chunks(chunks, docs), "orphan_chunks")).unionByName(one(document_stats(docs, drop_orphans(chunks, docs)), "document_stats"))
