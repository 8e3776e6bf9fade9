"""The library's tables derived from the given test tables; ``plans.sql`` derives them the same way in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import chat_title, preprocess_query, query_variations

EPOCH = "timestamp_ntz'2024-01-01 00:00:00'"
NOW_EVENTS = "timestamp_ntz'2024-01-30 12:00:00'"
NOW_CHATS = "timestamp_ntz'2024-01-05 12:00:00'"


def now(events: bool = True) -> Column:
    return F.expr(NOW_EVENTS if events else NOW_CHATS)


def after(**parts: Column) -> Column:
    """The epoch plus whole minutes or hours."""
    minutes = sum((v * 60 if k == "hours" else v for k, v in parts.items()), F.lit(0))
    return F.expr(EPOCH) + F.make_dt_interval(mins=minutes.cast("int"))


class Tables:
    """Logical tables of one folder of test data."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir = spark, sf_dir

    @functools.cached_property
    def n_documents(self) -> int:
        return self.raw("documents").count()

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def raw_text(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), "text")

    def dirty_text(self) -> DataFrame:
        k, t = F.col("id") % 4, F.col("text")
        dirty = F.when(k == 0, F.concat(F.substring(t, 1, 10), F.lit("\x01"), t.substr(F.lit(11), F.length(t)))).when(k == 1, F.replace(t, F.lit("\n"), F.lit("\r\n"))).when(k == 2, F.concat(t, F.lit("\n" * 5 + "\x0bend"))).otherwise(t)
        return self.raw_text().select("id", dirty.alias("text"))

    def knowledge_documents(self) -> DataFrame:
        i = F.col("doc_id")
        kinds = F.array(*map(F.lit, ["pdf", "txt", "md", "docx", "epub"]))
        return self.raw("documents").select(
            i.alias("id"), (i % 4).alias("user_id"), F.concat(F.lit("doc-"), i.cast("string")).alias("title"), F.get(kinds, (i % 5).cast("int")).alias("file_type"), (F.col("n_chars") * 1000).alias("file_size"),
            F.when(i % 3 != 0, F.concat(F.lit("https://files.example/"), i.cast("string"))).alias("file_url"), after(minutes=i).alias("created_at"),
        )

    def document_chunks(self) -> DataFrame:
        docs, n = self.raw("documents"), self.n_documents
        e = self.raw("embeddings").withColumn("doc_id", F.col("vec_id") % n)
        v = F.col("vec_id")
        return e.join(docs.select("doc_id", "text"), "doc_id", "left").select(
            v.alias("id"), F.floor(v / 5).alias("document_id"), (v % 5).cast("int").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"), "embedding", after(minutes=v).alias("created_at")
        )

    def orphans(self) -> DataFrame:
        return self.document_chunks().withColumn("document_id", F.when(F.col("id") % 7 == 0, F.col("document_id") + 1000000).otherwise(F.col("document_id")))

    def queries(self) -> DataFrame:
        c = self.document_chunks().select(F.col("id").alias("item_id"), "content", "embedding")
        words = F.array_join(F.slice(F.split("content", " "), 1, 6), " ")
        i = F.col("item_id")
        t = F.when(i % 3 == 0, F.concat(F.lit("what "), words)).otherwise(words)
        t = F.when(i % 5 == 0, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(t)
        return self.raw("benchmark").select("item_id").join(c, "item_id").select(i.alias("query_id"), (i % 4).alias("user_id"), t.alias("text"), "embedding")

    def variations(self) -> DataFrame:
        """Variations with stand-in vectors: the query's, turned by the variation's number."""
        q = self.queries().select("query_id", "user_id", "embedding", F.posexplode(query_variations(preprocess_query("text"))).alias("variation_no", "text"))
        n = F.col("variation_no")
        return q.withColumn("embedding", F.concat(F.slice("embedding", n + 1, F.size("embedding")), F.slice("embedding", F.lit(1), n)))

    def messages(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), F.col("text").alias("text"))))
        return self.raw("conversations").select((c * 100 + t).alias("id"), c.alias("chat_id"), "role", F.col("text").alias("content"), parts.alias("parts"), after(hours=c, minutes=t).alias("created_at"))

    def chats(self) -> DataFrame:
        first = F.min_by("text", F.when(F.col("role") == "user", F.col("turn")))
        i = F.col("id")
        g = self.raw("conversations").groupBy(F.col("conv_id").alias("id")).agg(first.alias("first"))
        return g.select("id", (i % 15).alias("user_id"), chat_title("first").alias("title"), F.when(i % 4 == 0, "public").otherwise("private").alias("visibility"), after(hours=i).alias("created_at"))

    def users(self) -> DataFrame:
        i = F.col("id")
        ids = self.raw("conversations").select((F.col("conv_id") % 15).alias("id")).distinct()
        return ids.select("id", F.when(i % 3 == 0, F.concat(F.lit("guest-"), i.cast("string"))).otherwise(F.concat(F.lit("u"), i.cast("string"), F.lit("@example.org"))).alias("email"))

    def votes(self) -> DataFrame:
        return self.messages().filter("role = 'assistant'").select("chat_id", F.col("id").alias("message_id"), (F.col("id") % 2 == 0).alias("is_upvoted"), F.col("created_at").alias("ts"))

    def new_votes(self) -> DataFrame:
        v = self.votes().filter("message_id % 3 = 0")
        return v.select("chat_id", "message_id", (~F.col("is_upvoted")).alias("is_upvoted"), (F.col("ts") + F.expr("interval 1 hour")).alias("ts"))

    def doc_versions(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        return self.raw("conversations").select(c.alias("id"), after(hours=c, minutes=t).alias("created_at"), F.concat(F.lit("Document "), c.cast("string")).alias("title"), F.col("text").alias("content"), F.lit("text").alias("kind"), (c % 15).alias("user_id"))

    def suggestions(self) -> DataFrame:
        c, t = F.col("conv_id"), F.col("turn")
        sentence = F.regexp_extract("text", r"^([^.!?]+[.!?]*)", 1)
        odd = (c * 100 + t) % 4 == 0
        return self.raw("conversations").select(
            (c * 100 + t).alias("id"), c.alias("document_id"), after(hours=c, minutes=t).alias("document_created_at"), F.when(odd, F.concat(F.lit("#"), sentence)).otherwise(sentence).alias("original_text"), F.lit("better").alias("suggested_text"), F.lit(False).alias("is_resolved")
        )

    def search_stats(self) -> DataFrame:
        return self.raw("events").select("user_id", F.md5("props").alias("query_hash"), F.col("value").alias("execution_time_ms"), (F.col("event_id") % 26).cast("int").alias("result_count"), F.col("ts").cast("timestamp_ntz").alias("created_at"))

    def query_cache(self) -> DataFrame:
        e = self.raw("events").filter("event_type = 'purchase'").groupBy("user_id", F.md5("props").alias("query_hash")).agg(F.min("ts").cast("timestamp_ntz").alias("created_at"))
        return e.select("user_id", "query_hash", "created_at", (F.col("created_at") + F.expr("interval 1 hour")).alias("expires_at"), F.lit(1).alias("hit_count"))

    def cache_writes(self) -> DataFrame:
        return self.raw("events").filter("event_type = 'click'").select("user_id", F.md5("props").alias("query_hash"), F.col("ts").cast("timestamp_ntz").alias("ts"))

    def message_stream(self) -> DataFrame:
        return self.raw("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", F.when(F.col("event_type").isin("view", "click"), "user").otherwise("assistant").alias("role"))

    def old_messages(self) -> DataFrame:
        """Messages of the old shape: JSON parts, with calls and their results, repeats, images and empty reasoning mixed in."""
        i, lit = F.col("id").cast("string"), F.lit
        text = F.to_json(F.struct(F.col("content").alias("content"), F.col("content").alias("text"), lit("text").alias("type")))
        said = F.to_json(F.struct(F.col("content").alias("text"), lit("text").alias("type")))
        call = F.concat(lit('{"args":{"limit":3,"tags":["a",'), i, lit(']},"toolCallId":"c'), i, lit('","toolName":"search","type":"tool-call"}'))
        result = F.concat(lit('[{"result":{"hits":['), i, lit('],"more":null},"toolCallId":"c'), i, lit('","toolName":"search","type":"tool-result"}]'))
        image = lambda n: F.concat(lit('{"image":"data:'), i, lit(f'/{n}","type":"image"}}'))
        idle = lit('{"reasoning":"undefined","type":"reasoning"}')
        listed = lambda *parts: F.concat(lit("["), F.concat_ws(",", *parts), lit("]"))
        mine, odd = F.col("role") == "assistant", F.col("id") % 2 == 1
        body = F.when(mine & ~odd, listed(text, call)).when(mine & odd, listed(said, said, idle, image(1), image(2), image(1))).otherwise(listed(text))
        m = self.messages()
        rows = m.select("id", "chat_id", "role", body.alias("content"), "created_at")
        return rows.unionByName(m.filter(mine & ~odd).select((F.col("id") + 100_000_000).alias("id"), "chat_id", lit("tool").alias("role"), result.alias("content"), "created_at"))
