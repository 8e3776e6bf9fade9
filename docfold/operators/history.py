"""Chats, messages, votes, versions and suggestions: lookups, deletes and merges as table in, table out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def chat_history_page(chats: DataFrame, limit: int, cursors: DataFrame | None = None, side: str | None = None) -> DataFrame:
    """H1: per user the newest ``limit`` chats, and whether there are more.

    ``cursors(user_id, chat_id)`` with ``side`` ``ending_before`` (older than the cursor) or ``starting_after``
    (newer; still the newest first).  A cursor that isn't among the chats is an error.
    """
    if (cursors is None) != (side is None) or side not in (None, "ending_before", "starting_after"):
        raise ValueError("give cursors with one side")
    rows = chats
    if cursors is not None:
        at = cursors.join(chats.select(F.col("id").alias("chat_id"), F.col("created_at").alias("_at")), "chat_id", "left")
        at = at.withColumn("_at", F.when(F.col("_at").isNull(), F.raise_error(F.concat(F.lit("unknown chat "), F.col("chat_id").cast("string"))).cast("timestamp_ntz")).otherwise(F.col("_at")))
        rows = rows.join(at.select("user_id", "_at"), "user_id")
        rows = rows.filter(F.col("created_at") < F.col("_at") if side == "ending_before" else F.col("created_at") > F.col("_at")).drop("_at")
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    read = rows.withColumn("position", F.row_number().over(w)).filter(F.col("position") <= limit + 1)
    return read.withColumn("has_more", F.max("position").over(Window.partitionBy("user_id")) > limit).filter(F.col("position") <= limit)


def messages_by_chat(messages: DataFrame, chat_ids: DataFrame) -> DataFrame:
    """H2: the messages of chats, with their place by time."""
    w = Window.partitionBy("chat_id").orderBy("created_at", "id")
    return messages.join(chat_ids, "chat_id", "left_semi").withColumn("position", F.row_number().over(w))


def last_messages(messages: DataFrame) -> DataFrame:
    """H3: per chat the last message's id, and the last user message's (null if none)."""
    at = F.struct("created_at", "id")
    return messages.groupBy("chat_id").agg(F.max_by("id", F.when(F.col("role") == "user", at)).alias("last_user_message"), F.max_by("id", at).alias("trailing_message"))


def all_versions(versions: DataFrame) -> DataFrame:
    """H4: versions of each document with their index from 0; of one time, in the order of their contents."""
    return versions.withColumn("version", F.row_number().over(Window.partitionBy("id").orderBy("created_at", "content")) - 1)


def latest_version(versions: DataFrame) -> DataFrame:
    """H4: the last version of each document; of one time, the last in the order of their contents."""
    w = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("content"))
    return versions.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def version_at(versions: DataFrame, index: int) -> DataFrame:
    """H4: when each document's version of that index was made."""
    return all_versions(versions).filter(F.col("version") == index).select("id", "created_at")


def list_documents(docs: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """H5: per user a page of documents, newest first."""
    w = Window.partitionBy("user_id").orderBy(F.desc("created_at"), F.desc("id"))
    page = docs.withColumn("position", F.row_number().over(w)).filter(F.col("position").between(offset + 1, offset + limit))
    return page.withColumn("has_file_url", F.col("file_url").isNotNull())


def user_chunks(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """H6: chunks with their document's user and title."""
    return chunks.join(docs.select(F.col("id").alias("document_id"), "user_id", "title"), "document_id")


def chunks_batch(chunks: DataFrame, docs: DataFrame, ids: DataFrame) -> DataFrame:
    """H7: chunks of a list of ids, with their documents and place in the order of document and index."""
    w = Window.partitionBy("document_id").orderBy("chunk_index")
    return user_chunks(chunks.join(ids, "id", "left_semi"), docs).withColumn("position", F.row_number().over(w))


def has_documents(users: DataFrame, docs: DataFrame) -> DataFrame:
    """H8: whether each user has a document."""
    n = docs.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return users.select(F.col("id").alias("user_id")).join(n, "user_id", "left").select("user_id", F.coalesce(F.col("n") > 0, F.lit(False)).alias("has_documents"))


def chat_date_bucket(created: Column, now: Column) -> Column:
    """H9: today, yesterday, lastWeek, lastMonth or older."""
    day = F.to_date(now)
    return (
        F.when(F.to_date(created) == day, "today").when(F.to_date(created) == F.date_sub(day, 1), "yesterday").when(created > now - F.expr("interval 7 days"), "lastWeek")
        .when(created > now - F.expr("interval 1 month"), "lastMonth").otherwise("older")
    )


def rows_of(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Votes of chats, suggestions of documents: rows whose ``key`` is listed."""
    return rows.join(ids, key, "left_semi")


def authorize(requests: DataFrame, owned: DataFrame) -> DataFrame:
    """``requests(request_id, user_id, id)`` against owners ``owned(id, owner_id)``: ok, forbidden, not_found."""
    j = requests.join(owned, "id", "left")
    return j.select("request_id", F.when(F.col("owner_id").isNull(), "not_found").when(F.col("owner_id") == F.col("user_id"), "ok").otherwise("forbidden").alias("status"))


def locate_suggestions(suggestions: DataFrame, versions: DataFrame) -> DataFrame:
    """Where each suggestion's text starts and ends in its version; (0, 0) when it isn't there."""
    v = versions.select(F.col("id").alias("document_id"), F.col("created_at").alias("document_created_at"), "content")
    at = F.instr(F.col("content"), F.col("original_text"))
    return suggestions.join(v, ["document_id", "document_created_at"]).select(
        F.col("id").alias("suggestion_id"), F.when(at > 0, at - 1).otherwise(0).alias("start_at"), F.when(at > 0, at - 1 + F.length("original_text")).otherwise(0).alias("end_at")
    )


def upsert_votes(current: DataFrame, new: DataFrame) -> DataFrame:
    """M1: the last vote on each message stays; a new vote wins over a current one of the same time."""
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy("chat_id", "message_id").orderBy(F.desc("ts"), F.desc("_new"), F.desc("is_upvoted"))
    return both.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_new")


def delete_chats(chats: DataFrame, messages: DataFrame, votes: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M2: chats without those of ``ids(chat_id)``, and what is left of their messages and votes."""
    return chats.join(ids.withColumnRenamed("chat_id", "id"), "id", "left_anti"), messages.join(ids, "chat_id", "left_anti"), votes.join(ids, "chat_id", "left_anti")


def truncate_messages(messages: DataFrame, votes: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M3: messages of ``cutoffs(chat_id, ts)`` at or after their cutoff go, and the votes on them."""
    cut = messages.join(cutoffs, "chat_id", "left")
    gone = cut.filter(F.col("created_at") >= F.col("ts")).select("chat_id", F.col("id").alias("message_id"))
    left = cut.filter(F.col("ts").isNull() | (F.col("created_at") < F.col("ts"))).drop("ts")
    return left, votes.join(gone, ["chat_id", "message_id"], "left_anti")


def truncate_versions(versions: DataFrame, suggestions: DataFrame, cutoffs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """M4: versions of ``cutoffs(id, ts)`` after their cutoff go, and the suggestions on them; also the removed."""
    cut = versions.join(cutoffs, "id", "left")
    late = F.coalesce(F.col("created_at") > F.col("ts"), F.lit(False))
    s = suggestions.join(cutoffs.select(F.col("id").alias("document_id"), "ts"), "document_id", "left")
    s_left = s.filter(F.col("ts").isNull() | (F.col("document_created_at") <= F.col("ts"))).drop("ts")
    return cut.filter(~late).drop("ts"), s_left, cut.filter(late).drop("ts")


def delete_documents(docs: DataFrame, chunks: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """M5: documents that ``requests(id, user_id)`` name by their owner go, with their chunks."""
    gone = docs.join(requests, ["id", "user_id"], "left_semi").select("id")
    return docs.join(gone, "id", "left_anti"), chunks.join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_anti")


def set_visibility(chats: DataFrame, changes: DataFrame) -> DataFrame:
    """Chats with the visibility that ``changes(id, new_visibility)`` give."""
    return chats.join(changes, "id", "left").withColumn("visibility", F.coalesce("new_visibility", "visibility")).drop("new_visibility")


def union_all(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
