"""The library's tables: schemas, reading, appending."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "users": "id long, email string",
    "chats": "id long, user_id long, title string, visibility string, created_at timestamp_ntz",
    "messages": "id long, chat_id long, role string, content string, parts string, created_at timestamp_ntz",
    "votes": "chat_id long, message_id long, is_upvoted boolean, ts timestamp_ntz",
    "doc_versions": "id long, created_at timestamp_ntz, title string, content string, kind string, user_id long",
    "suggestions": "id long, document_id long, document_created_at timestamp_ntz, original_text string, suggested_text string, is_resolved boolean",
    "knowledge_documents": "id long, user_id long, title string, file_type string, file_size long, file_url string, created_at timestamp_ntz",
    "document_chunks": "id long, document_id long, chunk_index int, content string, embedding array<float>, created_at timestamp_ntz",
    "search_stats": "user_id long, query_hash string, execution_time_ms double, result_count int, created_at timestamp_ntz",
    "query_cache": "user_id long, query_hash string, created_at timestamp_ntz, expires_at timestamp_ntz, hit_count int",
}
#: Tables that are read by user are laid out in that many folders by a hash of the user.
BUCKETS = 64


def read_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet", users: DataFrame | list[int] | None = None) -> DataFrame:
    """A table, or the rows of some users: a list of ids, or ``users(user_id)``.

    With ``users`` only the folders that their hash names are opened: listed before the scan for a list, by dynamic
    partition pruning for a table.
    """
    if users is None:
        return spark.read.format(fmt).schema(SCHEMAS[name]).load(f"{root}/{name}")
    rows = spark.read.format(fmt).schema(f"{SCHEMAS[name]}, bucket int").load(f"{root}/{name}")
    if isinstance(users, DataFrame):
        asked = users.select("user_id", user_bucket(F.col("user_id")).alias("bucket")).distinct()
        return rows.join(asked, ["user_id", "bucket"], "left_semi").drop("bucket").select(*_columns(name))
    ids = spark.createDataFrame([(u,) for u in users], "user_id long").select(user_bucket(F.col("user_id")).alias("b")).distinct().collect()
    return rows.filter(F.col("bucket").isin([r.b for r in ids]) & F.col("user_id").isin(users)).drop("bucket")


def user_bucket(user: Column) -> Column:
    return F.pmod(F.xxhash64(user.cast("long")), F.lit(BUCKETS)).cast("int")


def _columns(name: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[name].split(", ")]


def write_table(df: DataFrame, root: str, name: str, fmt: str = "parquet", mode: str = "append") -> None:
    """Appends to (or with ``mode`` replaces) a table; tables of users are laid out in folders by :func:`user_bucket`."""
    out = df.select(*_columns(name))
    if "user_id" in out.columns:
        out.withColumn("bucket", user_bucket(F.col("user_id"))).write.format(fmt).mode(mode).partitionBy("bucket").save(f"{root}/{name}")
    else:
        out.write.format(fmt).mode(mode).save(f"{root}/{name}")


def write_bucketed(df: DataFrame, root: str, name: str, key: str, catalog_name: str, buckets: int = 64, mode: str = "overwrite") -> DataFrame:
    """Writes a table of :data:`SCHEMAS` in hash buckets of ``key``, sorted by it, and gives it back as read.

    Jobs that join, group or window by that key then need no shuffle of the table: M3, A4 and G5 on messages, votes and
    chats by chat, H5 and H6 on documents by user.  Tables that meet must have the same number of buckets.  A join by
    more columns than the key needs ``spark.sql.requireAllClusterKeysForCoPartition=false``.
    """
    out = df.select(*_columns(name))
    out.repartition(buckets, key).write.format("parquet").mode(mode).option("path", f"{root}/{name}").bucketBy(buckets, key).sortBy(key).saveAsTable(catalog_name)
    return df.sparkSession.table(catalog_name)
