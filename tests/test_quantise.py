"""Search by product quantisation against the exact search."""

import numpy as np
from conftest import DATA
from pyspark.sql import functions as F

from docfold.operators import quantise, vector
from docfold.plans.registry import QUERIES
from docfold.sources.fixtures import Tables


def test_recall_and_vectors_read(spark):
    """At least nine of ten are found while less than a tenth of a user's vectors are read."""
    rows = QUERIES["v18_quantised_recall"](spark, DATA).collect()
    assert sum(r.found for r in rows) >= 0.9 * sum(r.wanted for r in rows) and len(rows) > 5
    assert all(r.read < 0.1 for r in rows)


def test_codes_estimate_products():
    """A table's sum is the query's product with the vector that a code stands for."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 8))
    words = np.array([quantise._k_means(x[:, 2 * p : 2 * p + 2], 16) for p in range(4)])
    books = quantise.Codebooks(np.zeros((1, 8)), words)
    code = books.encode(x)
    held = np.concatenate([words[p][code[:, p]] for p in range(4)], axis=1)
    for p in range(4):
        cut = x[:, None, 2 * p : 2 * p + 2]
        assert (code[:, p] == ((cut - words[p][None]) ** 2).sum(2).argmin(1)).all()
    q = rng.normal(size=8)
    np.testing.assert_allclose(books.products(q)[np.arange(4), code].sum(1), held @ q)
    assert ((x - held) ** 2).mean() < 0.2


def test_few_rows_and_odd_vectors(spark):
    """Fewer rows than code words, null, empty and short vectors, and users without chunks."""
    vectors = [[1.0, 0.0, 0.0, 0.0], [0.9, 0.1, 0.0, 0.0], [0.0, 1.0, 0.0, 0.0], None, [], [1.0, 2.0], [0.0, 0.0, 0.0, 0.0]]
    chunks = spark.createDataFrame([(k, k // 2, k % 2, "", v) for k, v in enumerate(vectors)], "id long, document_id long, chunk_index int, content string, embedding array<float>")
    docs = spark.createDataFrame([(k, 1, "t") for k in range(9)], "id long, user_id long, title string")
    q = spark.createDataFrame([(1, 1, [1.0, 0.05, 0.0, 0.0]), (2, 2, [1.0, 0.0, 0.0, 0.0]), (3, 1, None)], "query_id long, user_id long, embedding array<float>")
    books = quantise.train_codebooks(chunks.filter(F.size("embedding") == 4), 2, 2)
    index = quantise.encode_chunks(chunks, books)
    assert sorted(r.chunk_id for r in index.collect()) == [0, 1, 2, 6]
    got = quantise.quantised_search(q, index, chunks, docs, books, k=2, probes=5, candidates=4).collect()
    assert [(r.query_id, r.rank, r.chunk_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1, 0), (1, 2, 1)]


def test_slots_split_a_large_list(spark):
    t = Tables(spark, DATA)
    chunks, docs, q = t.document_chunks(), t.knowledge_documents(), t.queries()
    books = quantise.train_codebooks(chunks, 4, 16, words=32)
    index = quantise.encode_chunks(chunks, books)
    few, many = (quantise.coded_candidates(q, index, docs, books, 20, 4, slot_rows=n).select("query_id", "chunk_id") for n in (7, 10**6))
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))
    exact = vector.similarity_search(q, chunks, docs, 10).select("query_id", "chunk_id")
    assert exact.join(many, ["query_id", "chunk_id"]).count() >= 0.8 * exact.count()


def test_bounds_leave_out_what_cannot_be_found(spark):
    """With every candidate allowed the best ten are the exact ones, and most rows are never compared."""
    t = Tables(spark, DATA)
    chunks, q = t.document_chunks().select("id", "document_id", "chunk_index", F.lit("").alias("content"), "embedding"), t.queries().limit(5)
    docs = t.knowledge_documents().withColumn("user_id", F.lit(1).cast("long"))
    q = q.withColumn("user_id", F.lit(1).cast("long"))
    books = quantise.train_codebooks(chunks, 4, 32)
    index = quantise.encode_chunks(chunks, books)
    for slot_rows in (50, 10**6):
        found = quantise.coded_candidates(q, index, docs, books, 1 << 30, 4, slot_rows, k=10)
        exact = vector.similarity_search(q, chunks, docs, 10)
        assert exact.join(found, ["query_id", "chunk_id"]).count() == exact.count() >= 50
        assert found.count() < 0.5 * q.count() * index.count()
