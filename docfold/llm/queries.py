"""The registered queries of the operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment as _align
from . import byte_bpe as _bpe
from . import exact_dedup as _exact
from . import katz as _katz
from . import langid as _lang
from . import line_dedup as _lines
from . import minhash as _minhash
from . import packing as _packing
from . import quality as _quality
from . import suffix_dedup as _suffix
from . import toxicity as _tox
from . import vector_search as _vectors
from . import whitening as _white
from .common import crc32_mod, table


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = _quality.train_quality(docs, labels.filter(crc32_mod(F.col("doc_id"), 5) != 0))
    return _quality.score_quality(docs, model).select(
        "doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    net = _tox.train_toxicity(docs, labels.filter(crc32_mod(F.col("doc_id"), 5) != 0))
    return _tox.score_toxicity(docs, net).select(
        "doc_id", (crc32_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _suffix.remove_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = _bpe.encode_documents(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return _bpe.decode_documents(encoded, ranks).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = _lang.train_langid(docs.filter(crc32_mod(F.col("doc_id"), 3) != 1))
    return _lang.identify_language(docs, models).select(
        "doc_id", (crc32_mod(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected"
    )


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(table(spark, sf_dir, "documents"), keep="max")


def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return _vectors.exact_top_k(vectors, vectors.filter("vec_id % 100 = 0"), 10)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _katz.katz_scores(table(spark, sf_dir, "documents"), crc32_mod(F.col("doc_id"), 10) != 0)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _white.whitened_components(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    aligned = _align.align_documents(table(spark, sf_dir, "documents"), a, b)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return aligned.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_quality": op1_quality, "op2_toxicity": op2_toxicity, "op3_suffix_dedup": op3_suffix_dedup, "op4_byte_bpe": op4_byte_bpe, "op5_minhash": op5_minhash, "op6_langid": op6_langid, "op7_exact_dedup": op7_exact_dedup, "op8_exact_topk": op8_exact_topk, "op9_packing": op9_packing, "op10_katz": op10_katz, "op11_whitening": op11_whitening, "op12_alignment": op12_alignment, "op13_line_dedup": op13_line_dedup}

ORACLES = {
    "op8_exact_topk": """
        WITH whole AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
            FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
            FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(q.v) = len(c.v)
        )
        SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM scored
        WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 10
    """,
    "op7_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
    """,
    "op13_line_dedup": """
        WITH lines AS (
            SELECT doc_id, l[n] AS line, n, translate(trim(l[n], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS u(n)
        ), held AS (
            SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
        ), told AS (
            SELECT lines.*, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN held USING (key)
        )
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM told GROUP BY doc_id
    """,
}
