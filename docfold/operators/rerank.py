"""Reranking of search results: DataFrame steps on ``query_id``; all windows share that partitioning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dynamic_threshold, extract_keywords, relevance_label, token_estimate
from .vector import TIES, bulk_similarity_search


def _by_similarity(*more: Column) -> Window:
    return Window.partitionBy("query_id").orderBy(*more, F.desc("similarity"), *TIES)


def two_decimals(x: Column) -> Column:
    return F.floor(x * 100 + 0.5) / 100


def distinct_by_prefix(rows: DataFrame, keys: list[str], order: list, size: int = 100) -> DataFrame:
    """The first row of each content prefix, in the given order."""
    w = Window.partitionBy(*keys, F.substring("content", 1, size)).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def search_variations(variations: DataFrame, chunks: DataFrame, docs: DataFrame, limit: int = 10) -> DataFrame:
    """V3: results of a query's variations, unique by content prefix, first seen first.

    A variation counts only while the ones before it have given fewer than ``limit`` unique results.  Which
    results are unique depends on earlier variations alone, so that is a running count.
    """
    found = bulk_similarity_search(variations, chunks, docs, 2 * limit, 0.1, ("query_id", "variation_no"))
    unique = distinct_by_prefix(found, ["query_id"], ["variation_no", "rank"])
    before = F.rank().over(Window.partitionBy("query_id").orderBy("variation_no")) - 1
    return unique.withColumn("_before", before).filter(F.col("_before") < limit).drop("_before")


def threshold_and_cap(rows: DataFrame, least: DataFrame | Column | float, cap: int = 25) -> DataFrame:
    """V4: rows of at least that similarity, the best ``cap`` per query.

    ``least`` is a number, a column of the rows, or a table ``query_id, least`` with a floor for each query.
    """
    if isinstance(least, DataFrame):
        kept = rows.join(least.select("query_id", F.col("least").alias("_least")), "query_id").filter(F.col("similarity") >= F.col("_least")).drop("_least")
    else:
        kept = rows.filter(F.col("similarity") >= least)
    return kept.withColumn("rank", F.row_number().over(_by_similarity())).filter(F.col("rank") <= cap)


def boost_keywords(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """V5: adds to the similarity for each keyword of the original query that the content holds as a word."""
    q = queries.select("query_id", extract_keywords("text").alias("_keys"))
    low = F.lower("content")

    def gain(total: Column, key: Column) -> Column:
        word = F.rlike(low, F.concat(F.lit("(?<![A-Za-z0-9_])"), key, F.lit("(?![A-Za-z0-9_])")))
        place = F.when(F.position(key, low) - 1 < 100, 0.05).otherwise(0.02)
        return total + F.when(word, F.least(F.lit(0.1), F.length(key) * F.lit(0.01)) + place).otherwise(0.0)

    boost = F.least(F.lit(0.2), F.aggregate("_keys", F.lit(0.0), gain))
    out = rows.join(q, "query_id").withColumn("_boost", boost)
    return (
        out.withColumn("keyword_boost", F.when(F.col("_boost") > 0, F.col("_boost"))).withColumn("similarity", F.when(F.col("_boost") > 0, F.least(F.lit(0.99), F.col("similarity") + F.col("_boost"))).otherwise(F.col("similarity")))
        .drop("_keys", "_boost").withColumn("rank", F.row_number().over(_by_similarity()))
    )


def diversify_by_document(rows: DataFrame, limit: int = 10) -> DataFrame:
    """V6: at most ``limit`` rows per query, shared among its documents; free places go to the best of the rest."""
    per_query = Window.partitionBy("query_id")
    in_doc = Window.partitionBy("query_id", "document_id").orderBy(F.desc("similarity"), *TIES)
    docs = F.size(F.collect_set("document_id").over(per_query))
    share = F.greatest(F.lit(1), F.ceil(F.lit(limit) / docs))
    flagged = rows.withColumn("_share", share).withColumn("_second", (F.row_number().over(in_doc) > F.col("_share")).cast("int"))
    kept = flagged.withColumn("_n", F.row_number().over(_by_similarity(F.col("_second")))).filter(F.col("_n") <= limit).drop("_share", "_second", "_n")
    return kept.withColumn("rank", F.row_number().over(_by_similarity()))


def adjacent_chunks(hits: DataFrame, chunks: DataFrame, docs: DataFrame, reach: int = 2) -> DataFrame:
    """V7: neighbours of hits within ``reach`` places, of the user's documents; an equi-join on exploded places."""
    near = hits.select("query_id", "user_id", "chunk_id", "document_id", F.col("chunk_index").alias("of_index"), F.explode(F.array(*[F.lit(k) for k in range(-reach, reach + 1) if k])).alias("step"))
    near = near.withColumn("chunk_index", F.col("of_index") + F.col("step"))
    return near.join(_places(chunks, docs), ["user_id", "document_id", "chunk_index"]).select("query_id", "user_id", "chunk_id", "document_id", "of_index", "chunk_index", "neighbour_id", F.col("neighbour_content").alias("content"), F.abs("step").alias("distance"))


def _places(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """What is at each place of each user's documents."""
    d = docs.select(F.col("id").alias("document_id"), "user_id")
    return chunks.select("document_id", "chunk_index", F.col("id").alias("neighbour_id"), F.col("content").alias("neighbour_content")).join(d, "document_id")


def add_context(rows: DataFrame, chunks: DataFrame, docs: DataFrame, least: float = 0.45, reach: int = 2, limit: int = 30, dedupe: bool = False) -> DataFrame:
    """V8: strong hits bring their neighbours along, at a similarity that falls with distance.

    Queries without a strong hit stay as they are.  With ``dedupe`` a chunk that is there already isn't added.
    Each row is exploded into itself (step 0) and its neighbours' places, so the rows are computed once.
    """
    strong = F.col("similarity") >= least
    steps = F.when(strong, F.array(*map(F.lit, range(-reach, reach + 1)))).otherwise(F.array(F.lit(0)))
    each = rows.select("query_id", "user_id", "chunk_id", "document_id", F.col("chunk_index").alias("hit_index"), "content", "title", "similarity", "keyword_boost", F.explode(steps).alias("step"))
    each = each.withColumn("chunk_index", F.col("hit_index") + F.col("step"))
    # Only steps have a place to look up.
    looked_up = each.withColumn("_at", F.when(F.col("step") != 0, F.col("chunk_index")))
    there = _places(chunks, docs).withColumnRenamed("chunk_index", "_at")
    met = looked_up.join(there, ["user_id", "document_id", "_at"], "left").filter("step = 0 or neighbour_id is not null")
    own, away = F.col("step") == 0, F.abs("step")
    every = met.select(
        "query_id", "user_id", F.when(own, F.col("chunk_id").cast("string")).otherwise(F.concat(F.col("chunk_id").cast("string"), F.lit("_adjacent_"), F.col("chunk_index").cast("string"))).alias("result_id"),
        F.when(own, F.col("chunk_id")).otherwise(F.col("neighbour_id")).alias("chunk_id"), "document_id", "chunk_index", F.when(own, F.col("content")).otherwise(F.col("neighbour_content")).alias("content"), "title",
        F.when(own, F.col("similarity")).otherwise(F.greatest(F.lit(0.15), F.col("similarity") - F.lit(0.1) * away)).alias("similarity"), F.when(own, F.col("keyword_boost")).alias("keyword_boost"), (~own).alias("is_context"),
        F.when(~own, F.col("hit_index")).alias("of_index"), F.when(~own, away).alias("distance"),
    )
    if dedupe:
        w = Window.partitionBy("query_id", "chunk_id").orderBy("is_context", F.desc("similarity"), "result_id")
        every = every.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    w = Window.partitionBy("query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), *TIES, "result_id")
    return every.withColumn("_any", F.max("is_context").over(w)).withColumn("rank", F.row_number().over(order)).filter((F.col("rank") <= limit) | ~F.col("_any")).drop("_any")


def format_results(rows: DataFrame, size: int = 2400, preview: int = 200) -> DataFrame:
    """V9: display form of ranked rows."""
    cut = F.when(F.length("content") > size, F.concat(F.substring("content", 1, size), F.lit("..."))).otherwise(F.col("content"))
    out = rows.withColumn("original_length", F.length("content")).withColumn("relevance", relevance_label("similarity")).withColumn("content", cut)
    section = F.concat(F.lit("Chunk "), (F.col("chunk_index") + 1).cast("string"))
    if "chapter_title" in rows.columns:
        section = F.when((F.col("file_type") == "epub") & F.col("chapter_order").isNotNull(), F.concat(F.lit("Chapter: "), F.coalesce("chapter_title", F.concat(F.lit("Chapter "), (F.col("chapter_order") + 1).cast("string"))))).otherwise(section)
    return out.select(
        "query_id", "rank", "result_id", "content", two_decimals(F.col("similarity")).alias("similarity"), F.col("title").alias("document"), "document_id", section.alias("section"), "relevance", two_decimals(F.col("keyword_boost")).alias("keyword_boost"),
        F.length("content").alias("content_length"), "original_length", F.when(F.length("content") > preview, F.concat(F.substring("content", 1, preview), F.lit("..."))).otherwise(F.col("content")).alias("preview"),
    )


def token_budget(rows: DataFrame, max_chars: int = 48_000, max_tokens: int = 12_000, count_tokens: Callable[[Column], Column] = token_estimate) -> DataFrame:
    """The longest prefix by rank within both budgets; running sums only grow, so a filter gives a prefix.

    ``count_tokens`` counts the tokens of a content: a quarter of its characters, or exactly
    (:func:`~docfold.functions.text.bpe_token_count`).  Counts stay in ``tokens``, which V11 adds up.
    """
    run = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    counted = rows.withColumn("tokens", count_tokens(F.col("content")))
    out = counted.withColumn("_c", F.sum("content_length").over(run)).withColumn("_t", F.sum("tokens").over(run))
    return out.filter((F.col("_c") <= max_chars) & (F.col("_t") <= max_tokens)).drop("_c", "_t")


def result_stats(rows: DataFrame, before: DataFrame, max_tokens: int = 12_000) -> DataFrame:
    """Per query, sizes of what was kept, and how many results there were."""
    kept = rows.groupBy("query_id").agg(F.sum("tokens").alias("total_tokens"), F.sum("content_length").cast("long").alias("total_chars"), F.count(F.lit(1)).alias("actual_results"), F.count_if(F.col("original_length") > F.col("content_length")).alias("truncated_results"))
    total = before.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))
    n = lambda c: F.coalesce(c, F.lit(0))
    t, ch, a = n("total_tokens"), n("total_chars"), n("actual_results")
    return total.join(kept, "query_id", "left").select(
        "query_id", "total_results", a.alias("actual_results"), t.alias("total_tokens"), ch.alias("total_chars"), F.when(a > 0, F.floor(t / a + 0.5)).otherwise(0).alias("average_tokens"),
        F.when(ch > 0, two_decimals(t / ch)).otherwise(0.0).alias("token_char_ratio"), F.floor(t / max_tokens * 100 + 0.5).alias("budget_used"), n("truncated_results").alias("truncated_results"),
    )


# The parts of a summary's sentences.
def search_summary(queries: DataFrame, rows: DataFrame, profile: str = "default") -> DataFrame:
    """One sentence or two on the results of each query."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "document")))
    high, very = (0.6, 0.45) if profile == "default" else (0.8, 0.8)
    g = rows.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.transform(ordered, lambda x: x["document"])).alias("titles"), F.count_if(F.col("similarity") >= high).alias("h"), F.count_if(F.col("similarity") >= very).alias("v"))
    s = lambda c: c.cast("string")
    are = lambda c: F.when(c == 1, " result is").otherwise(" results are")
    n, h, v, titles = F.col("n"), F.col("h"), F.col("v"), F.col("titles")
    where = F.when(F.size(titles) == 1, F.concat(F.lit(' from the document "'), F.get(titles, F.lit(0)), F.lit('"'))).otherwise(
        F.concat(F.lit(" across "), s(F.size(titles)), F.lit(" documents: "), F.array_join(F.slice(titles, 1, 3), ", "), F.when(F.size(titles) > 3, "...").otherwise(""))
    )
    more = F.when(v > h, F.concat(F.lit(" and "), s(v - h), F.lit(" additional"), are(v - h), F.lit(" very relevant"))).otherwise("") if profile == "default" else F.lit("")
    tail = F.when(h > 0, F.concat(F.lit(". "), s(h), are(h), F.lit(" highly relevant"), more, F.lit(".")))
    if profile == "default":
        tail = tail.when(v > 0, F.concat(F.lit(". "), s(v), are(v), F.lit(" very relevant.")))
    found = F.concat(F.lit("Found "), s(n), F.lit(" relevant result"), F.when(n == 1, "").otherwise("s"), F.lit(' for "'), F.col("text"), F.lit('"'), where, F.coalesce(tail, F.lit("")))
    none = F.concat(F.lit('No relevant content found for "'), F.col("text"), F.lit("\" in the user's knowledge base."))
    return queries.select("query_id", "text").join(g, "query_id", "left").select("query_id", F.coalesce(found, none).alias("summary"))


# Fixed value: the template of a prompt.
PROMPT = """You are a helpful AI assistant that answers questions based on the provided context from the user's documents.

Context from user's documents:
{context}

Question: {question}

Instructions:
- Answer the question based on the provided context
- If the context doesn't contain enough information to answer the question, say so clearly
- Cite specific parts of the context when relevant
- Be concise but comprehensive
- If multiple documents are referenced, mention which documents the information comes from

Answer:"""


def build_rag_prompts(questions: DataFrame, sources: DataFrame, template: str = PROMPT) -> DataFrame:
    """One prompt per question from its sources in rank order (``k`` rows per question at most)."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])
    context = sources.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("context"))
    before, rest = template.split("{context}")
    middle, after = rest.split("{question}")
    prompt = F.concat(F.lit(before), F.coalesce("context", F.lit("")), F.lit(middle), F.col("text"), F.lit(after))
    return questions.select("query_id", "text").join(context, "query_id", "left").select("query_id", prompt.alias("prompt"))


def search_pipeline(
    queries: DataFrame, variations: DataFrame, chunks: DataFrame, docs: DataFrame, limit: int = 10, least: float = 0.22, max_chars: int = 48_000, max_tokens: int = 12_000,
    dynamic: bool = True, count_tokens: Callable[[Column], Column] = token_estimate,
) -> DataFrame:
    """Variations, threshold, boost, diversity, context, format, budget.

    The floor of each query follows from its text (T13, from ``least``), or is ``least`` itself without ``dynamic``.
    """
    floors = queries.select("query_id", dynamic_threshold("text", least).alias("least")) if dynamic else least
    rows = threshold_and_cap(search_variations(variations, chunks, docs, limit), floors)
    rows = diversify_by_document(boost_keywords(rows, queries), limit)
    return token_budget(format_results(add_context(rows, chunks, docs)), max_chars, max_tokens, count_tokens)
