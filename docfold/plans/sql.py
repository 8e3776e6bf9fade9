"""The logical tables and the search steps as SQL for DuckDB; a query's SQL takes the ones it names."""

from __future__ import annotations

import re

from ..functions.text import CONTROL, FILLER_WORDS, QUESTION_WORDS, STOP_WORDS, WS

EPOCH = "TIMESTAMP '2024-01-01 00:00:00'"
NOW_EVENTS = "TIMESTAMP '2024-01-30 12:00:00'"
NOW_CHATS = "TIMESTAMP '2024-01-05 12:00:00'"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def trim_ws(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def collapse_ws(x: str) -> str:
    return trim_ws(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def no_controls(x: str) -> str:
    return f"regexp_replace(regexp_replace(coalesce({x}, ''), '\\x00', '', 'g'), '{CONTROL}', '', 'g')"


def keep_format(x: str) -> str:
    return trim_ws(f"regexp_replace(regexp_replace(regexp_replace({no_controls(x)}, '\\r\\n', chr(10), 'g'), '\\r', chr(10), 'g'), '\\n{{4,}}', repeat(chr(10), 3), 'g')")


def flat(x: str) -> str:
    return collapse_ws(no_controls(x))


def summarize(x: str, n: int = 150) -> str:
    c = collapse_ws(x)
    head = f"substr({c}, 1, {n + 1})"
    cut = f"regexp_extract({head}, '(?s)^(.+) ', 1)"
    return f"CASE WHEN length({c}) <= {n} THEN {c} ELSE CASE WHEN {cut} <> '' THEN {cut} ELSE substr({c}, 1, {n}) END || '...' END"


def preprocess(x: str) -> str:
    return collapse_ws(f"regexp_replace({collapse_ws(x)}, '(?i)\\b({'|'.join(FILLER_WORDS)})\\b', ' ', 'g')")


def keywords(x: str) -> str:
    plain = f"regexp_replace(replace(replace({x}, '\"', ''), '''', ''), '[^A-Za-z0-9_\\t\\n\\x0B\\f\\r {WS[1:-1]}]', ' ', 'g')"
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return f"list_filter(regexp_split_to_array(lower({plain}), '{WS}+'), lambda w: length(w) > 1 AND w NOT IN ({stops}))"


QUESTION = "|".join(QUESTION_WORDS)


def label(x: str) -> str:
    return f"CASE WHEN {x} >= 0.75 THEN 'Highly Relevant' WHEN {x} >= 0.6 THEN 'Very Relevant' WHEN {x} >= 0.45 THEN 'Relevant' WHEN {x} >= 0.3 THEN 'Somewhat Relevant' WHEN {x} >= 0.2 THEN 'Potentially Relevant' ELSE 'Low Relevance' END"


def threshold(q: str, m: str) -> str:
    """The default profile."""
    n = f"len(regexp_split_to_array({q}, '{WS}+'))"
    base = f"CASE WHEN {n} < 3 THEN greatest(0.18::DOUBLE, {m} - 0.15::DOUBLE) WHEN {n} < 5 THEN greatest(0.20::DOUBLE, {m} - 0.10::DOUBLE) WHEN {n} < 8 THEN greatest(0.22::DOUBLE, {m} - 0.05::DOUBLE) ELSE least(0.40::DOUBLE, {m} + 0.05::DOUBLE) END"
    asks = f"CASE WHEN regexp_matches({q}, '(?i)\\b({QUESTION})\\b') THEN greatest(0.18::DOUBLE, ({base}) - 0.05::DOUBLE) ELSE {base} END"
    return f"CASE WHEN contains({q}, '\"') THEN greatest(0.16::DOUBLE, ({asks}) - 0.07::DOUBLE) ELSE {asks} END"


def cosine(a: str, b: str) -> str:
    return f"list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[])"


CTES = {
    "raw_text": "SELECT doc_id AS id, text FROM documents",
    "dirty_text": """SELECT id, CASE id % 4 WHEN 0 THEN substr(text, 1, 10) || chr(1) || substr(text, 11) WHEN 1 THEN replace(text, chr(10), chr(13) || chr(10))
        WHEN 2 THEN text || repeat(chr(10), 5) || chr(11) || 'end' ELSE text END AS text FROM raw_text""",
    "kd": f"""SELECT doc_id AS id, doc_id % 4 AS user_id, 'doc-' || doc_id AS title, ['pdf', 'txt', 'md', 'docx', 'epub'][doc_id % 5 + 1] AS file_type, n_chars * 1000 AS file_size,
        CASE WHEN doc_id % 3 <> 0 THEN 'https://files.example/' || doc_id END AS file_url, {EPOCH} + to_minutes(doc_id) AS created_at FROM documents""",
    "chunks": f"""SELECT vec_id AS id, vec_id // 5 AS document_id, CAST(vec_id % 5 AS INTEGER) AS chunk_index, coalesce(text, '') AS content, embedding, {EPOCH} + to_minutes(vec_id) AS created_at
        FROM embeddings LEFT JOIN documents ON doc_id = vec_id % (SELECT count(*) FROM documents)""",
    "orphan_input": "SELECT * REPLACE (CASE WHEN id % 7 = 0 THEN document_id + 1000000 ELSE document_id END AS document_id) FROM chunks",
    "asked": """SELECT item_id AS query_id, item_id % 4 AS user_id, CASE WHEN item_id % 5 = 0 THEN '"' || t || '"' ELSE t END AS text, embedding FROM (
        SELECT item_id, embedding, CASE WHEN item_id % 3 = 0 THEN 'what ' ELSE '' END || array_to_string(string_split(content, ' ')[1:6], ' ') AS t
        FROM benchmark JOIN chunks ON chunks.id = item_id)""",
    "varied": f"""SELECT query_id, user_id, CAST(n - 1 AS INTEGER) AS variation_no, vs[n] AS text, CASE WHEN n = 1 THEN embedding ELSE list_concat(embedding[n:], embedding[1:n-1]) END AS embedding
        FROM (SELECT *, list_filter(l, lambda x, i: list_position(l, x) = i) AS vs FROM (
            SELECT query_id, user_id, embedding, list_filter([q, CASE WHEN regexp_matches(q, '(?i)^({QUESTION})\\b') THEN regexp_replace(q, '(?i)^({QUESTION}){WS}+', '') END,
                CASE WHEN len(regexp_split_to_array(q, '{WS}+')) > 2 AND len(ks) > 1 AND lower(array_to_string(ks, ' ')) <> lower(q) THEN array_to_string(ks, ' ') END], lambda x: x IS NOT NULL) AS l
            FROM (SELECT query_id, user_id, embedding, {preprocess('text')} AS q, {keywords(preprocess('text'))} AS ks FROM asked))), unnest(range(1, len(vs) + 1)) AS u(n)""",
    "scored": f"""SELECT a.query_id, a.user_id, c.id AS chunk_id, c.document_id, c.chunk_index, c.content, d.title, {cosine('c.embedding', 'a.embedding')} AS similarity
        FROM asked a JOIN kd d ON d.user_id = a.user_id JOIN chunks c ON c.document_id = d.id""",
    "v3": f"""SELECT * FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY variation_no) - 1 AS before FROM (
            SELECT * FROM (SELECT a.query_id, a.user_id, a.variation_no, c.id AS chunk_id, c.document_id, c.chunk_index, c.content, d.title, {cosine('c.embedding', 'a.embedding')} AS similarity
                FROM varied a JOIN kd d ON d.user_id = a.user_id JOIN chunks c ON c.document_id = d.id) WHERE similarity >= 0.1
            QUALIFY row_number() OVER (PARTITION BY query_id, variation_no ORDER BY similarity DESC, document_id, chunk_index, chunk_id) <= 20)
        QUALIFY row_number() OVER (PARTITION BY query_id, substr(content, 1, 100) ORDER BY variation_no, similarity DESC, document_id, chunk_index, chunk_id) = 1) WHERE before < 10""",
    "v4": "SELECT * FROM v3 WHERE similarity >= {floor} QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) <= 25",
    "v5": f"""SELECT query_id, user_id, chunk_id, document_id, chunk_index, content, title, CASE WHEN b > 0 THEN b END AS keyword_boost, CASE WHEN b > 0 THEN least(0.99::DOUBLE, similarity + b) ELSE similarity END AS similarity FROM (
        SELECT v4.*, least(0.2::DOUBLE, coalesce(list_sum(list_transform(ks, lambda k: CASE WHEN regexp_matches(lower(content), '\\b' || k || '\\b')
            THEN least(0.1::DOUBLE, length(k) * 0.01::DOUBLE) + CASE WHEN strpos(lower(content), k) - 1 < 100 THEN 0.05::DOUBLE ELSE 0.02::DOUBLE END ELSE 0::DOUBLE END)), 0)) AS b
        FROM v4 JOIN (SELECT query_id, {keywords('text')} AS ks FROM asked) USING (query_id))""",
    "v6": """SELECT * EXCLUDE (share, nth) FROM (SELECT *, greatest(1, ceil({results} / (count(DISTINCT document_id) OVER (PARTITION BY query_id)))) AS share,
            row_number() OVER (PARTITION BY query_id, document_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) AS nth FROM v5)
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN nth > share THEN 1 ELSE 0 END, similarity DESC, document_id, chunk_index, chunk_id) <= {results}""",
    "v7": """SELECT h.query_id, h.user_id, h.chunk_id, h.document_id, h.chunk_index AS of_index, c.chunk_index, c.id AS neighbour_id, c.content, abs(c.chunk_index - h.chunk_index) AS distance, h.title, h.similarity
        FROM v6 h JOIN kd d ON d.id = h.document_id AND d.user_id = h.user_id JOIN chunks c ON c.document_id = h.document_id AND abs(c.chunk_index - h.chunk_index) BETWEEN 1 AND 2""",
    "v8": """SELECT * FROM (
        SELECT query_id, CAST(chunk_id AS VARCHAR) AS result_id, chunk_id, document_id, chunk_index, content, title, similarity, keyword_boost, false AS is_context FROM v6
        UNION ALL SELECT query_id, chunk_id || '_adjacent_' || chunk_index, neighbour_id, document_id, chunk_index, content, title, greatest(0.15::DOUBLE, similarity - 0.1::DOUBLE * distance), NULL, true FROM v7 WHERE similarity >= 0.45)
        QUALIFY NOT bool_or(is_context) OVER (PARTITION BY query_id) OR row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id, result_id) <= 30""",
    "v9": f"""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, document_id, chunk_index, chunk_id, result_id) AS INTEGER) AS rank, result_id, content, floor(sim * 100 + 0.5) / 100 AS similarity, title AS document, document_id,
        'Chunk ' || (chunk_index + 1) AS section, {label('sim')} AS relevance, floor(keyword_boost * 100 + 0.5) / 100 AS keyword_boost, length(content) AS content_length, original_length, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS preview
        FROM (SELECT * EXCLUDE (content, similarity), similarity AS sim, length(content) AS original_length, CASE WHEN length(content) > 2400 THEN substr(content, 1, 2400) || '...' ELSE content END AS content FROM v8)""",
    "v10": """SELECT * EXCLUDE (c, t) FROM (SELECT *, CAST(ceil(length(content) / 4) AS BIGINT) AS tokens, sum(content_length) OVER w AS c, sum(CAST(ceil(length(content) / 4) AS BIGINT)) OVER w AS t FROM v9
        WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE c <= 3000 AND t <= 12000""",
    "messages": f"SELECT conv_id * 100 + turn AS id, conv_id AS chat_id, role, text AS content, {EPOCH} + to_hours(conv_id) + to_minutes(turn) AS created_at FROM conversations",
    "chats": f"""SELECT id, id % 15 AS user_id, CASE WHEN length(first) > 50 THEN substr(first, 1, 47) || '...' ELSE first END AS title, CASE WHEN id % 4 = 0 THEN 'public' ELSE 'private' END AS visibility, {EPOCH} + to_hours(id) AS created_at
        FROM (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS first FROM conversations GROUP BY conv_id)""",
    "users": "SELECT DISTINCT conv_id % 15 AS id, CASE WHEN (conv_id % 15) % 3 = 0 THEN 'guest-' || (conv_id % 15) ELSE 'u' || (conv_id % 15) || '@example.org' END AS email FROM conversations",
    "votes": "SELECT chat_id, id AS message_id, id % 2 = 0 AS is_upvoted, created_at AS ts FROM messages WHERE role = 'assistant'",
    "new_votes": "SELECT chat_id, message_id, NOT is_upvoted AS is_upvoted, ts + to_hours(1) AS ts FROM votes WHERE message_id % 3 = 0",
    "versions": f"SELECT conv_id AS id, {EPOCH} + to_hours(conv_id) + to_minutes(turn) AS created_at, text AS content, turn FROM conversations",
    "suggestions": f"""SELECT conv_id * 100 + turn AS id, conv_id AS document_id, {EPOCH} + to_hours(conv_id) + to_minutes(turn) AS document_created_at,
        CASE WHEN (conv_id * 100 + turn) % 4 = 0 THEN '#' ELSE '' END || regexp_extract(text, '^([^.!?]+[.!?]*)', 1) AS original_text FROM conversations""",
    "search_stats": "SELECT user_id, md5(props) AS query_hash, value AS execution_time_ms, event_id % 26 AS result_count, ts AS created_at FROM events",
    "query_cache": "SELECT user_id, md5(props) AS query_hash, min(ts) AS created_at, min(ts) + to_hours(1) AS expires_at, 1 AS hit_count FROM events WHERE event_type = 'purchase' GROUP BY ALL",
    "cache_writes": "SELECT user_id, md5(props) AS query_hash, ts FROM events WHERE event_type = 'click'",
    "doc_sizes": "SELECT document_id, count(*) AS n, sum(length(content)) AS chars, min(created_at) AS first, max(created_at) AS last FROM chunks GROUP BY 1",
    "cutoffs": "SELECT chat_id, max(created_at) FILTER (role = 'user') AS ts FROM messages WHERE chat_id % 3 = 0 GROUP BY 1",
    "old_parts": """SELECT id, chat_id, role, created_at, rank, unnest(list_transform(parts, lambda p, k: {'k': k, 'part': p})) AS p FROM (
        SELECT id, chat_id, role, created_at, CASE WHEN role = 'assistant' AND id % 2 = 0 THEN 0 WHEN role = 'assistant' THEN 2 ELSE 3 END AS rank,
            CASE WHEN role = 'assistant' AND id % 2 = 0 THEN [full_text, '{"args":{"limit":3,"tags":["a",' || id || ']},"toolCallId":"c' || id || '","toolName":"search","type":"tool-call"}']
                 WHEN role = 'assistant' THEN [said, said, '{"reasoning":"undefined","type":"reasoning"}', '{"image":"data:' || id || '/1","type":"image"}', '{"image":"data:' || id || '/2","type":"image"}', '{"image":"data:' || id || '/1","type":"image"}']
                 ELSE [full_text] END AS parts
        FROM (SELECT *, '{"content":' || to_json(content) || ',"text":' || to_json(content) || ',"type":"text"}' AS full_text, '{"text":' || to_json(content) || ',"type":"text"}' AS said FROM messages)
        UNION ALL SELECT id + 100000000, chat_id, 'tool', created_at, 1, ['{"result":{"hits":[' || id || '],"more":null},"toolCallId":"c' || id || '","toolName":"search","type":"tool-result"}'] FROM messages WHERE role = 'assistant' AND id % 2 = 0)""",
    "ranked_messages": """SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY created_at, rank, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section
        FROM (SELECT DISTINCT id, chat_id, role, created_at, rank FROM old_parts)""",
}


#: The floor of each query in v4, if it isn't a number.
DYNAMIC = f"(SELECT {threshold('text', '0.22::DOUBLE')} FROM asked WHERE asked.query_id = v3.query_id)"


def sql(body: str, results: int = 4, floor: str = "0.22") -> str:
    """``body`` with the tables it names, and those they name, in front; diversified search keeps ``results`` rows over ``floor``."""
    need: list[str] = []

    def add(text: str) -> None:
        for name in CTES:
            if name not in need and re.search(rf"\b{name}\b(?!\s*\()", re.sub(r"AS \w+", "", text)):
                add(CTES[name])
                if name not in need:
                    need.append(name)

    add(body)
    return ("WITH " + ", ".join(f"{n} AS ({CTES[n].replace('{results}', str(results)).replace('{floor}', floor)})" for n in need) + " " if need else "") + body
