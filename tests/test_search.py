"""Exact token budgets, floors by query, and bulk search."""

import base64

import numpy as np
import public_tokenizers
import tiktoken
from conftest import DATA
from pyspark.sql import functions as F

from docfold.functions import text as T
from docfold.operators import rerank, vector
from docfold.sources.fixtures import Tables

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_budget_by_exact_tokens(spark):
    """A prefix by rank within the budget of a real tokenizer, as counted by its library; V11 adds the same counts."""
    with open(RANKS, "rb") as f:
        bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    texts = ["one two three", "éèà ünï 漢字", "", "x" * 50, "short", "the end of it all"]
    rows = spark.createDataFrame([(q, r + 1, f"{q}-{r}", t * (q + 1), len(t) * (q + 1), len(t) * (q + 1)) for q in range(3) for r, t in enumerate(texts)], "query_id long, rank int, result_id string, content string, content_length int, original_length int")
    kept = rerank.token_budget(rows, max_tokens=40, count_tokens=T.bpe_token_count(RANKS, public_tokenizers.PATTERN))
    want = {}
    for q in range(3):
        total = 0
        for r, t in enumerate(texts):
            total += len(bpe.encode_ordinary(t * (q + 1)))
            if total > 40:
                break
            want[f"{q}-{r}"] = len(bpe.encode_ordinary(t * (q + 1)))
    assert {r.result_id: r.tokens for r in kept.collect()} == want and 3 < len(want) < 18
    sums = {r.query_id: r.total_tokens for r in rerank.result_stats(kept, rows).collect()}
    assert sums == {q: sum(n for k, n in want.items() if k.startswith(f"{q}-")) for q in range(3)}


def test_floor_of_each_query(spark):
    rows = spark.createDataFrame([(q, 1, 1, c, s) for q in (1, 2) for c, s in enumerate((0.5, 0.25, 0.19, 0.17))], "query_id long, document_id long, chunk_index int, chunk_id long, similarity double")
    queries = spark.createDataFrame([(1, "two words"), (2, "one two three four five six seven eight")], "query_id long, text string")
    floors = queries.select("query_id", T.dynamic_threshold("text", 0.22).alias("least"))
    got = {(r.query_id, r.chunk_id) for r in rerank.threshold_and_cap(rows, floors).collect()}
    assert got == {(1, 0), (1, 1), (1, 2), (2, 0)}


def test_bulk_search_in_many_slots_and_blocks(spark):
    t = Tables(spark, DATA)
    q, c, d = t.variations(), t.document_chunks(), t.knowledge_documents()
    keys = ("query_id", "variation_no")
    one = lambda df: sorted((*[r[k] for k in keys], r["rank"], r.chunk_id, round(r.similarity, 9)) for r in df.collect())
    few = one(vector.bulk_similarity_search(q, c, d, 7, 0.1, keys, slot_rows=9, query_rows=3))
    assert few == one(vector.similarity_search(q, c, d, 7, 0.1, keys)) and few


def test_bulk_search_of_odd_vectors(spark):
    docs = spark.createDataFrame([(1, 1, "t")], "id long, user_id long, title string")
    vectors = [[1.0, 0.0], [1.0, 0.0], [0.0, 0.0], None, [1.0, 0.0, 0.0], []]
    chunks = spark.createDataFrame([(k, 1, k, "c", v) for k, v in enumerate(vectors)], "id long, document_id long, chunk_index int, content string, embedding array<float>")
    q = spark.createDataFrame([(1, 1, [2.0, 0.0]), (2, 1, None), (3, 9, [1.0, 0.0]), (4, 1, [1.0, 1.0, 1.0, 1.0])], "query_id long, user_id long, embedding array<float>")
    got = sorted((r.query_id, r["rank"], r.chunk_id) for r in vector.bulk_similarity_search(q, chunks, docs).collect())
    assert got == [(1, 1, 0), (1, 2, 1)]
    assert vector.bulk_similarity_search(q.limit(0), chunks, docs).count() == 0
    assert np.isfinite([r.similarity for r in vector.bulk_similarity_search(q, chunks, docs, least=-1.0).collect()]).all()


def test_pipeline_plan_has_no_interpreted_product(spark):
    t = Tables(spark, DATA)
    plan = rerank.search_pipeline(t.queries(), t.variations(), t.document_chunks(), t.knowledge_documents())._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_counts_of_null_texts(spark):
    df = spark.createDataFrame([(None,), ("",), ("a b",)], "t string")
    assert [r.n for r in df.select(T.bpe_token_count(RANKS, public_tokenizers.PATTERN)(F.col("t")).alias("n")).collect()] == [0, 0, 2]
