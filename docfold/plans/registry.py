"""Every operator as a query over whole tables, with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking, embedding, history, migrate, quantise, rerank, stats, vector
from ..sources import files
from ..sources.buckets import BucketTable
from ..sources.fixtures import Tables, now
from ..streaming import jobs, windows
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None, results: int = 4, floor: str = "0.22"):
    """Registers a query with its SQL, in which search steps keep ``results`` rows a query over ``floor``."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[name] = S.sql(oracle, results, floor)
        return f

    return add


def six(c: Column | str) -> Column:
    return F.round(c, 6)


def times(df: DataFrame, *columns: str) -> DataFrame:
    """Times as text, which every engine prints alike."""
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


#: A row of this time ends a stream: it moves the watermark past all windows, so that each is given out once.
END_OF_STREAM = "timestamp'2100-01-01 00:00:00'"


def stream(t: Tables, df: DataFrame, job: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drains ``job`` over the rows of ``df`` as a stream in append mode, and gives what it has written.

    A last row of user -1 closes all windows and sessions; what comes of it is left out.
    """
    root = stream_dir(t)
    stream_file(t, df, f"{root}/in")
    rows = t.spark.readStream.schema(df.schema).parquet(f"{root}/in")
    out = job(rows)

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/b={number}")

    jobs.drain(out, sink, f"{root}/checkpoint")
    return t.spark.read.schema(out.schema).parquet(f"{root}/out").drop("b").filter("not user_id <=> -1")


def stream_file(t: Tables, df: DataFrame, path: str) -> None:
    """Writes the rows of a stream, and a last one of user -1 that closes it."""
    ends = {"ts": F.expr(END_OF_STREAM), "role": F.lit("user"), "user_id": F.lit(-1), "query_hash": F.lit("")}
    last = t.spark.range(1).select(*[ends.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in df.schema])
    df.unionByName(last).write.parquet(path)


def stream_dir(t: Tables) -> str:
    """A new folder in ``spark.checkpoint.dir``; where that is unset, a temporary one, on one machine only."""
    shared = t.spark.conf.get("spark.checkpoint.dir", None) or t.spark.sparkContext.getCheckpointDir()
    if not shared:
        if not t.spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        t.spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        shared = t.spark.sparkContext.getCheckpointDir()
    return f"{shared.rstrip('/')}/stream-{uuid.uuid4().hex}"


# ---- sources ----
KIND = "CASE lower(regexp_extract(name, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'txt' THEN 'txt' WHEN 'md' THEN 'md' WHEN 'markdown' THEN 'md' WHEN 'docx' THEN 'docx' WHEN 'epub' THEN 'epub' END"


@register("s1_file_type", f"SELECT id, {KIND} AS file_type FROM (SELECT id, title || ['.PDF', '.txt', '.markdown', '.rtf', '', '.tar.epub'][id % 6 + 1] AS name FROM kd)")
def s1(t: Tables) -> DataFrame:
    ends = F.array(*map(F.lit, [".PDF", ".txt", ".markdown", ".rtf", "", ".tar.epub"]))
    return t.knowledge_documents().select("id", files.file_type(F.concat("title", F.get(ends, (F.col("id") % 6).cast("int")))).alias("file_type"))


_SENT = "['txt', 'md', 'rtf', 'epub', 'txt'][doc_id % 5 + 1]"
_BODY = "CASE doc_id % 5 WHEN 3 THEN 'no archive' WHEN 4 THEN '  ' || chr(10) ELSE text END"


def _sent_files(t: Tables) -> DataFrame:
    """A file for each document: three kinds of text (one unsupported), a damaged book, and blanks."""
    k = (F.col("doc_id") % 5).cast("int")
    ends = F.get(F.array(*map(F.lit, ["txt", "md", "rtf", "epub", "txt"])), k)
    body = F.when(k == 3, "no archive").when(k == 4, "  \n").otherwise(F.coalesce("text", F.lit("")))
    return t.raw("documents").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit("."), ends).alias("name"), body.cast("binary").alias("content"))


@register("s1_read_files", f"SELECT 'doc-' || doc_id || '.' || {_SENT} AS name, CASE {_SENT} WHEN 'rtf' THEN NULL ELSE {_SENT} END AS file_type, strlen({_BODY}) AS size, sha256({_BODY}) AS content_sha256 FROM documents")
def s1b(t: Tables) -> DataFrame:
    root = stream_dir(t)
    files.write_files(_sent_files(t), f"{root}/sent")
    return files.read_files(t.spark, f"{root}/sent").select("name", "file_type", "size", F.sha2("content", 256).alias("content_sha256"))


_HALVES = "doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) // 2 AS INTEGER) AS half"


@register("s1_archive_entries", f"""SELECT 'doc-' || doc_id || '.epub' AS name, CAST(k AS INTEGER) AS entry_no, ['mimetype', 'text/1.html', 'text/2.html'][k + 1] AS entry, strlen(body) AS size, sha256(body) AS content_sha256, NULL::VARCHAR AS error
    FROM (SELECT doc_id, k, CASE k WHEN 0 THEN 'application/epub+zip' WHEN 1 THEN left(text, half) ELSE substr(text, half + 1) END AS body FROM (SELECT {_HALVES} FROM documents WHERE doc_id % 3 = 0), unnest(range(0, 3)) AS u(k))
    UNION ALL SELECT 'doc-' || doc_id || '.epub', NULL, NULL, 0, NULL, 'BadZipFile: File is not a zip file' FROM documents WHERE doc_id % 3 = 1
    UNION ALL SELECT 'doc-' || doc_id || '.txt', NULL, NULL, 0, sha256(''), NULL FROM documents WHERE doc_id % 3 = 2""")
def s1c(t: Tables) -> DataFrame:
    """Books of three entries, books without a byte, and notes without a byte."""
    root, half = stream_dir(t), F.floor(F.length("text") / 2).cast("int")
    docs = t.raw("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    halves = docs.filter("doc_id % 3 = 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".epub")).alias("name"), F.left("text", half).alias("a"), F.expr("substr(text, cast(floor(length(text) / 2) as int) + 1)").alias("b"))
    empty = docs.filter("doc_id % 3 > 0").select(F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.expr("if(doc_id % 3 = 1, '.epub', '.txt')")).alias("name"), F.lit(b"").alias("content"))
    files.write_files(halves.mapInPandas(_books, "name string, content binary").unionByName(empty), f"{root}/sent")
    return files.read_entries(t.spark, f"{root}/sent").select("name", "entry_no", "entry", "size", F.sha2("content", 256).alias("content_sha256"), "error")


def _books(batches):
    """A book of two chapters from ``a`` and ``b``."""
    import io
    import zipfile

    for b in batches:
        out = []
        for x, y in zip(b["a"], b["b"]):
            with io.BytesIO() as f:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as z:
                    for entry, body in (("mimetype", "application/epub+zip"), ("text/1.html", x), ("text/2.html", y)):
                        z.writestr(entry, body)
                out.append(f.getvalue())
        yield b[["name"]].assign(content=out)


@register("s2_validate_files", """SELECT id, reason, reason IS NULL AND size > 4718592 AS needs_blob FROM (SELECT id, file_size AS size, CASE WHEN file_size > 15728640 THEN 'File size exceeds 15MB limit'
    WHEN id % 11 = 0 THEN 'Unsupported file type' WHEN file_size = 0 THEN 'No text content found' END AS reason FROM kd)""")
def s2(t: Tables) -> DataFrame:
    f = t.knowledge_documents().select("id", F.col("file_size").alias("size"), F.when(F.col("id") % 11 != 0, F.col("file_type")).alias("file_type"))
    return files.validate_files(f).select("id", "reason", "needs_blob")


@register("s2_validate_attachments", """SELECT id, CASE WHEN file_size * 4 > 52428800 THEN 'File size should be less than 50MB' WHEN id % 3 = 2 THEN 'File type should be JPEG or PNG' END AS reason FROM kd""")
def s2b(t: Tables) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["image/png", "image/jpeg", "image/gif"])), (F.col("id") % 3).cast("int"))
    return files.validate_attachments(t.knowledge_documents().select("id", (F.col("file_size") * 4).alias("size"), kind.alias("content_type"))).select("id", "reason")


@register("s4_read_write_tables", "SELECT id, user_id, title, file_type, file_size FROM kd")
def s4(t: Tables) -> DataFrame:
    from ..sources.tables import read_table, write_table

    root = stream_dir(t)
    write_table(t.knowledge_documents(), root, "knowledge_documents")
    return read_table(t.spark, root, "knowledge_documents").select("id", "user_id", "title", "file_type", "file_size")


@register("s4_read_for_users", "SELECT id, user_id, title FROM kd WHERE user_id IN (1, 3)")
def s4b(t: Tables) -> DataFrame:
    from ..sources.tables import read_table, write_table

    root = stream_dir(t)
    write_table(t.knowledge_documents(), root, "knowledge_documents")
    asked = t.knowledge_documents().filter("user_id in (1, 3)").select("user_id")
    return read_table(t.spark, root, "knowledge_documents", users=asked).select("id", "user_id", "title")


@register("s4_bucketed_message_count", "SELECT c.user_id, count(*) AS messages FROM messages m JOIN chats c ON c.id = m.chat_id WHERE role = 'user' AND m.created_at >= TIMESTAMP '2024-01-05 12:00:00' - INTERVAL 24 HOUR GROUP BY 1")
def s4c(t: Tables) -> DataFrame:
    """A4 over tables in buckets by chat: neither is shuffled to meet."""
    from ..sources.tables import write_bucketed

    root, tag = stream_dir(t), uuid.uuid4().hex
    m = write_bucketed(t.messages(), root, "messages", "chat_id", f"messages_{tag}", 8)
    c = write_bucketed(t.chats(), root, "chats", "id", f"chats_{tag}", 8)
    return stats.message_count(m, c, now(False))


@register("s5_vector_text", "SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def s5(t: Tables) -> DataFrame:
    v = T.parse_vector_text(T.format_vector_text("embedding"))
    return t.raw("embeddings").select("vec_id", v.alias("v")).select("vec_id", F.size("v").cast("long").alias("dims"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("total"))


@register("s6_clean_sheet_rows", """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) AS INTEGER) AS row_no, a AS A, b AS B FROM (
    SELECT vec_id AS id, n, CASE n WHEN 0 THEN 'x' || label WHEN 3 THEN 'y, z' END AS a, CASE n WHEN 0 THEN CAST(vec_id AS VARCHAR) WHEN 3 THEN 'end' END AS b FROM embeddings, unnest([0, 3]) AS u(n))""")
def s6(t: Tables) -> DataFrame:
    sheet = F.concat(F.lit("x"), F.col("label").cast("string"), F.lit(","), F.col("vec_id").cast("string"), F.lit('\n\n , \n"y, z",end\n'))
    return files.clean_sheet_rows(t.raw("embeddings").select(F.col("vec_id").alias("id"), sheet.alias("content"))).select("id", "row_no", "A", "B")


# ---- text ----
@register("t1_sanitize_keep_format", f"SELECT id, {S.keep_format('text')} AS clean FROM dirty_text")
def t1(t: Tables) -> DataFrame:
    return t.dirty_text().select("id", T.sanitize_keep_format("text").alias("clean"))


@register("t2_sanitize_flat", f"SELECT id, {S.flat('text')} AS clean FROM dirty_text")
def t2(t: Tables) -> DataFrame:
    return t.dirty_text().select("id", T.sanitize_flat("text").alias("clean"))


@register("t3_text_problems", f"""SELECT id, n > 0 AS has_control_chars, n AS control_chars, len(l) AS kinds, n = 0 AS is_safe FROM (
    SELECT id, len(regexp_extract_all(text, '{S.CONTROL}')) AS n, list_distinct(regexp_extract_all(text, '{S.CONTROL}')) AS l FROM dirty_text)""")
def t3(t: Tables) -> DataFrame:
    p = t.dirty_text().select("id", T.text_problems("text").alias("p"))
    return p.select("id", "p.has_control_chars", "p.control_chars", F.size("p.problem_chars").cast("long").alias("kinds"), "p.is_safe")


_STRIPPED = "coalesce(html, '')"
for _p in (r"(?i)<\?xml[^>]*>", r"(?i)<!DOCTYPE[^>]*>", r"(?is)<script[^>]*>.*?</script>", r"(?is)<style[^>]*>.*?</style>"):
    _STRIPPED = f"regexp_replace({_STRIPPED}, '{_p}', '', 'g')"
for _a, _b in T.ENTITIES:
    _STRIPPED = f"replace({_STRIPPED}, '{_a}', {S.quoted(_b)})"
_STRIPPED = f"regexp_replace(regexp_replace({_STRIPPED}, '(?i)</?(p|div|br|h[1-6]|li|tr)[^>]*>', chr(10), 'g'), '<[^>]*>', ' ', 'g')"


@register("t4_html_to_text", f"SELECT page_id, {S.collapse_ws(_STRIPPED)} AS plain FROM pages")
def t4(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.html_to_text("html").alias("plain"))


_BOOK = "coalesce(html, '')"
for _p, _r in ((r"(?is)<script[^>]*>.*?</script>", ""), (r"(?is)<style[^>]*>.*?</style>", ""), (r"(?i)javascript:", ""), (r"(?i)on[A-Za-z0-9_]+\s*=", ""), (r"<[^>]*>", " "), (r"&nbsp;", " "), (r"&[a-zA-Z0-9#]+;", " "), (S.WS + "+", " ")):
    _BOOK = f"regexp_replace({_BOOK}, '{_p}', '{_r}', 'g')"


@register("t5_clean_book_text", "SELECT page_id, " + S.keep_format(f"regexp_replace({_BOOK}, '([.!?])\\s*([A-Z])', '\\1 \\2', 'g')") + " AS clean FROM pages")
def t5(t: Tables) -> DataFrame:
    return t.raw("pages").select("page_id", T.clean_book_text("html").alias("clean"))


_LINES = "array_to_string(list_filter(string_split(html, chr(10)), lambda x: x <> ''), chr(10) || chr(10))"
_BOOK_TEXT = S.keep_format("regexp_replace(" + _BOOK.replace("coalesce(html, '')", "coalesce(plain, '')") + ", '([.!?])\\s*([A-Z])', '\\1 \\2', 'g')")


def _archives(batches):
    """EPUB and DOCX bytes around the text of each row."""
    import io
    import zipfile
    from xml.sax.saxutils import escape

    for b in batches:
        out = []
        for kind, text in zip(b["file_type"], b["text"]):
            body = text.encode()
            if kind in ("epub", "docx"):
                held = io.BytesIO()
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    if kind == "epub":
                        z.writestr("mimetype", "application/epub+zip")
                        z.writestr("OEBPS/style.css", "p { margin: 0 }")
                        z.writestr("OEBPS/part1.xhtml", text)
                    else:
                        z.writestr("word/document.xml", "<w:document><w:body>" + "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(x)}</w:t></w:r></w:p>' if x else "<w:p/>" for x in text.split("\n")) + "</w:body></w:document>")
                body = held.getvalue()
            out.append(body)
        yield b[["name", "file_type"]].assign(content=out)


@register("s3_extract_text", f"""SELECT CAST(page_id AS VARCHAR) AS name, ['epub', 'docx', 'txt'][page_id % 3 + 1] AS file_type, CASE page_id % 3 WHEN 0 THEN {_BOOK_TEXT} WHEN 1 THEN {S.keep_format(_LINES)} ELSE {S.keep_format('html')} END AS text, NULL AS error
    FROM (SELECT *, {S.collapse_ws(_STRIPPED)} AS plain FROM pages)""")
def s3(t: Tables) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["epub", "docx", "txt"])), (F.col("page_id") % 3).cast("int"))
    pages = t.raw("pages").select(F.col("page_id").cast("string").alias("name"), kind.alias("file_type"), F.coalesce("html", F.lit("")).alias("text"))
    return files.extract_text(pages.mapInPandas(_archives, "name string, file_type string, content binary"))


@register("t6_repair_spaced_letters")
def t6(t: Tables) -> DataFrame:
    spaced = F.concat(F.regexp_replace(F.substring("text", 1, 24), r"(\w)", "$1 "), F.lit(" "), F.col("text"))
    return t.raw_text().select("id", T.repair_spaced_letters(spaced).alias("repaired"))


@register("t7_summarize", f"SELECT id, {S.summarize('text')} AS summary FROM raw_text")
def t7(t: Tables) -> DataFrame:
    return t.raw_text().select("id", T.summarize("text").alias("summary"))


@register("t8_file_title", "SELECT id, regexp_replace('a.b/' || title || '.v2.' || file_type, '\\.[^/.]+$', '') AS title FROM kd")
def t8(t: Tables) -> DataFrame:
    return t.knowledge_documents().select("id", T.file_title(F.concat(F.lit("a.b/"), "title", F.lit(".v2."), "file_type")).alias("title"))


@register("t9_token_estimate", "SELECT id, CAST(ceil(length(text) / 4) AS BIGINT) AS tokens FROM raw_text")
def t9(t: Tables) -> DataFrame:
    return t.raw_text().select("id", T.token_estimate("text").alias("tokens"))


@register("t10_preprocess_query", f"SELECT id, {S.preprocess('text')} AS query FROM raw_text")
def t10(t: Tables) -> DataFrame:
    return t.raw_text().select("id", T.preprocess_query("text").alias("query"))


@register("t11_extract_keywords", f"SELECT id, array_to_string({S.keywords('text')}, ' ') AS keywords FROM raw_text")
def t11(t: Tables) -> DataFrame:
    return t.raw_text().select("id", F.array_join(T.extract_keywords("text"), " ").alias("keywords"))


@register("t12_query_variations", "SELECT query_id, variation_no, text FROM varied")
def t12(t: Tables) -> DataFrame:
    return t.variations().select("query_id", "variation_no", "text")


@register("t13_dynamic_threshold", f"SELECT query_id, variation_no, round({S.threshold('text', '0.22::DOUBLE')}, 6) AS threshold FROM varied UNION ALL SELECT query_id, -1, round({S.threshold('text', '0.22::DOUBLE')}, 6) FROM asked UNION ALL SELECT id, -2, round({S.threshold('text', '0.22::DOUBLE')}, 6) FROM raw_text")
def t13(t: Tables) -> DataFrame:
    rows = t.variations().select("query_id", "variation_no", "text").unionByName(t.queries().select("query_id", F.lit(-1).alias("variation_no"), "text")).unionByName(t.raw_text().select(F.col("id").alias("query_id"), F.lit(-2).alias("variation_no"), "text"))
    return rows.select("query_id", "variation_no", six(T.dynamic_threshold("text", 0.22)).alias("threshold"))


@register("t14_relevance_label", f"SELECT query_id, chunk_id, {S.label('similarity')} AS label FROM scored")
def t14(t: Tables) -> DataFrame:
    return _pairs(t).select("query_id", "chunk_id", T.relevance_label("similarity").alias("label"))


def _pairs(t: Tables) -> DataFrame:
    q = t.queries().select("query_id", "user_id", F.col("embedding").alias("q"))
    return vector.user_chunks_for_search(t.document_chunks(), t.knowledge_documents()).join(q, "user_id").withColumn("similarity", vector.cosine_similarity(F.col("embedding"), F.col("q")))


@register("t15_search_suggestions", f"""SELECT query_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS suggestions FROM (SELECT query_id, list_filter([CASE WHEN len(w) > 1 THEN array_to_string(w[1:len(w) - 1], ' ') END,
    CASE WHEN len(w) > 2 THEN array_to_string(w[2:], ' ') END, array_to_string(w, ' AND '), w[1]], lambda x: x IS NOT NULL) AS l FROM (SELECT query_id, regexp_split_to_array(text, '{S.WS}+') AS w FROM asked))""")
def t15(t: Tables) -> DataFrame:
    return t.queries().select("query_id", F.array_join(T.search_suggestions("text"), "|").alias("suggestions"))


@register("t16_message_text", f"SELECT id, content AS prompt_text, {S.trim_ws('content')} AS copy_text FROM messages")
def t16(t: Tables) -> DataFrame:
    return t.messages().select("id", T.message_text("parts").alias("prompt_text"), T.message_text("parts", "copy").alias("copy_text"))


@register("t17_chat_title", "SELECT id, CASE WHEN length(content) > 50 THEN substr(content, 1, 47) || '...' ELSE content END AS title FROM messages")
def t17(t: Tables) -> DataFrame:
    return t.messages().select("id", T.chat_title("content").alias("title"))


@register("t18_format_bytes", """SELECT id, CASE WHEN n = 0 THEN '0 Bytes' ELSE regexp_replace(printf('%.2f', floor(n / pow(1024, i) * 100 + 0.5) / 100), '\\.?0+$', '') || ' ' || ['Bytes', 'KB', 'MB', 'GB'][i + 1] END AS size
    FROM (SELECT *, CASE WHEN n >= 1073741824 THEN 3 WHEN n >= 1048576 THEN 2 WHEN n >= 1024 THEN 1 ELSE 0 END AS i FROM (SELECT id, CAST(file_size * CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.001 WHEN 2 THEN 1 ELSE 1000 END AS DOUBLE) AS n FROM kd))""")
def t18(t: Tables) -> DataFrame:
    k = F.col("id") % 4
    n = F.col("file_size") * F.when(k == 0, 0.0).when(k == 1, 0.001).when(k == 2, 1.0).otherwise(1000.0)
    return t.knowledge_documents().select("id", T.format_bytes(n).alias("size"))


@register("t19_blob_folder", "SELECT id, ['attachments', 'knowledge', 'artifacts'][id % 3 + 1] || CASE WHEN id % 2 = 0 THEN '' ELSE '/' || user_id END AS folder FROM kd")
def t19(t: Tables) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, ["attachment", "knowledge", "artifact"])), (F.col("id") % 3).cast("int"))
    return t.knowledge_documents().select("id", T.blob_folder(kind, F.when(F.col("id") % 2 != 0, F.col("user_id").cast("string"))).alias("folder"))


@register("t20_sanitize_metadata", f"SELECT id, {S.flat('text')} AS value FROM dirty_text")
def t20(t: Tables) -> DataFrame:
    m = T.sanitize_metadata(F.create_map(F.lit(" a\x01 key"), F.col("text")))
    return t.dirty_text().select("id", m.alias("m")).select("id", F.element_at("m", "a key").alias("value"))


@register("t20_sanitize_nested", f"SELECT id, {S.flat('text')} AS name, {S.flat('text')} AS tag, id AS n, {S.flat('text')} AS json_value FROM dirty_text")
def t20b(t: Tables) -> DataFrame:
    d = t.dirty_text()
    m = d.select("id", F.struct(F.col("text").alias("name"), F.array(F.struct(F.create_map(F.lit("k\x07"), F.array("text")).alias("tags"))).alias("parts"), F.col("id").alias("n")).alias("m"), F.to_json(F.struct(F.array(F.struct(F.col("text").alias("v"))).alias("l"))).alias("j"))
    clean = m.select("id", T.sanitize_nested("m", m.schema["m"].dataType).alias("m"), T.sanitize_json("j").alias("j"))
    return clean.select("id", "m.name", F.element_at(F.get("m.parts", F.lit(0))["tags"], "k")[0].alias("tag"), "m.n", F.from_json("j", "l array<struct<v:string>>")["l"][0]["v"].alias("json_value"))


@register("t21_user_type", "SELECT id, CASE WHEN regexp_matches(email, '^guest-\\d+$') THEN 'guest' ELSE 'regular' END AS user_type FROM users")
def t21(t: Tables) -> DataFrame:
    return t.users().select("id", T.user_type("email").alias("user_type"))


@register("t22_validate_message", """SELECT id, array_to_string(list_filter([CASE WHEN role <> 'user' THEN 'role' END, CASE WHEN length(content) NOT BETWEEN 1 AND 2000 THEN 'content' END, CASE WHEN length(content) NOT BETWEEN 1 AND 2000 THEN 'parts' END,
    CASE WHEN id % 5 = 0 THEN 'attachments' END], lambda x: x IS NOT NULL), ',') AS errors FROM messages""")
def t22(t: Tables) -> DataFrame:
    kinds = F.array(F.when(F.col("id") % 5 == 0, "image/gif").otherwise("image/png"))
    return t.messages().select("id", F.array_join(T.message_errors("role", "content", "parts", kinds), ",").alias("errors"))


# ---- chunks ----
FIXED = "SELECT id, CAST(i AS INTEGER) AS chunk_index, substr(text, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM raw_text, unnest(range(0, CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(text) - 1000) / 800) AS BIGINT) END)) AS u(i)"


@register("c1_chunk_fixed", FIXED)
def c1(t: Tables) -> DataFrame:
    return chunking.chunk_fixed(t.raw_text())


@register("c2_chunk_recursive")
def c2(t: Tables) -> DataFrame:
    return chunking.chunk_recursive(t.raw_text(), "rag").select("id", "chunk_index", "content", "metadata.tokens")


#: Splitting at blanks alone, without overlap, is a running choice that SQL can make.
WORDS = chunking.Profile(200, 0, (" ",), False)


@register("c2_chunk_by_words", """SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n) - 1 AS INTEGER) AS chunk_index, content FROM (SELECT id, n, regexp_replace(l[n], '^\\s+|\\s+$', '', 'g') AS content FROM (
    SELECT id, list_reduce(list_transform(list_filter(string_split(text, ' '), lambda x: x <> ''), lambda x: [x]),
        lambda kept, x: CASE WHEN length(kept[len(kept)]) < 200 AND length(x[1]) < 200 AND length(kept[len(kept)]) + 1 + length(x[1]) <= 200 THEN list_append(kept[1:len(kept) - 1], kept[len(kept)] || ' ' || x[1]) ELSE list_append(kept, x[1]) END) AS l
    FROM raw_text WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) > 0), unnest(range(1, len(l) + 1)) AS u(n)) WHERE content <> ''""")
def c2b(t: Tables) -> DataFrame:
    return chunking.chunk_recursive(t.raw_text(), WORDS).select("id", "chunk_index", "content")


def _lateral(t: Tables, call: str, columns: str) -> DataFrame:
    """A table function over all texts, called from SQL."""
    from ..functions.tables import register_table_functions

    register_table_functions(t.spark)
    view = f"texts_{uuid.uuid4().hex}"
    t.raw_text().createOrReplaceTempView(view)
    return t.spark.sql(f"SELECT id, {columns} FROM {view}, LATERAL {call}")


@register("c1_lateral_chunk_fixed", FIXED)
def c1b(t: Tables) -> DataFrame:
    return _lateral(t, "chunk_fixed(text, 1000, 200)", "chunk_index, content")


@register("c2_lateral_chunk_recursive")
def c2c(t: Tables) -> DataFrame:
    return _lateral(t, "chunk_recursive(text, 'rag')", "chunk_index, content")


@register("c3_document_record", f"""SELECT r.id, 'doc-' || r.id AS title, {S.summarize('r.text')} AS summary, arg_min(f.content, f.chunk_index) AS first_page_content, count(f.id) AS chunk_count, CAST(floor(avg(length(f.content)) + 0.5) AS BIGINT) AS avg_chunk_size, strlen(r.text) AS file_size, 'txt' AS file_type
    FROM raw_text r LEFT JOIN ({FIXED}) f ON f.id = r.id GROUP BY r.id, r.text""")
def c3(t: Tables) -> DataFrame:
    return chunking.document_record(t.raw_text().withColumn("name", F.concat(F.lit("doc-"), F.col("id").cast("string"), F.lit(".txt"))))


_PLAIN = FIXED.replace("800", "500").replace("1000", "500")


@register("c4_compare_chunkings", f"""SELECT id, a_count, round(a_mean, 6) AS a_mean, round(a_variance, 4) AS a_variance, b_count, round(b_mean, 6) AS b_mean, round(b_variance, 4) AS b_variance,
    CASE WHEN abs(b_count - a_count) < 2 AND abs(b_mean - a_mean) < 100 THEN 'equivalent' WHEN b_variance - a_variance < 0 THEN 'b' ELSE 'a' END AS recommendation
    FROM (SELECT id, count(*) AS a_count, avg(length(content)) AS a_mean, var_pop(length(content)) AS a_variance FROM ({FIXED}) GROUP BY id)
    JOIN (SELECT id, count(*) AS b_count, avg(length(content)) AS b_mean, var_pop(length(content)) AS b_variance FROM ({_PLAIN}) GROUP BY id) USING (id)""")
def c4(t: Tables) -> DataFrame:
    a, b = chunking.chunk_fixed(t.raw_text()), chunking.chunk_fixed(t.raw_text(), 500, 0)
    out = chunking.compare_chunkings(a, b)
    return out.withColumns({c: F.round(c, 6 if c.endswith("mean") else 4) for c in out.columns if c.endswith(("mean", "variance"))})


_LETTERS = ", ".join(f"length(content) - length(replace(content, '{x}', ''))" for x in embedding.LETTERS)


_EMBEDDED = f"SELECT id, len(v) AS dims, round(list_sum(list_transform(v, lambda x: x / n)), 3) AS total, round(v[1] / n, 3) AS first FROM (SELECT id, v, greatest(sqrt(list_sum(list_transform(v, lambda x: x * x))), 1) AS n FROM (SELECT id, [{_LETTERS}]::DOUBLE[] AS v FROM chunks))"


@register("c5_embed_chunks", _EMBEDDED)
def c5(t: Tables) -> DataFrame:
    e = embedding.embed_chunks(t.document_chunks().select("id", "content"), embedding.letter_embedder)
    return e.select("id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"), F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("first"))


@register("c5_embed_cached", _EMBEDDED)
def c5b(t: Tables) -> DataFrame:
    """A cache that knows half of the chunks' texts from an earlier run."""
    cache = embedding.embedding_cache(t.spark, f"{stream_dir(t)}/cache")
    chunks = t.document_chunks().select("id", "content")
    embedding.embed_cached(chunks.filter("id % 2 = 0"), embedding.letter_embedder, cache)
    e = embedding.embed_cached(chunks, embedding.letter_embedder, cache)
    return e.select("id", F.size("embedding").alias("dims"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias("total"), F.round(F.get("embedding", F.lit(0)).cast("double"), 3).alias("first"))


@register("c6_fit_dimension", """SELECT vec_id, 100 AS padded, 10 AS cut, round(list_sum(list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE))), 5) AS head FROM embeddings""")
def c6(t: Tables) -> DataFrame:
    e = t.raw("embeddings").select("vec_id", embedding.fit_dimension(F.col("embedding"), 100).alias("p"), embedding.fit_dimension(F.col("embedding"), 10).alias("c"))
    return e.select("vec_id", F.size("p").alias("padded"), F.size("c").alias("cut"), F.round(F.aggregate("c", F.lit(0.0), lambda s, x: s + x.cast("double")), 5).alias("head"))


@register("c7_embedding_report", """SELECT user_id, count(*) AS chunks, count(*) FILTER (c.id % 6 <> 0) AS valid, count(*) FILTER (c.id % 6 = 0) AS invalid, '64' AS dimensions, count(DISTINCT title) AS titles FROM chunks c JOIN kd d ON d.id = c.document_id GROUP BY user_id""")
def c7(t: Tables) -> DataFrame:
    c = t.document_chunks().withColumn("embedding", F.when(F.col("id") % 6 != 0, F.col("embedding")))
    return embedding.embedding_report(c, t.knowledge_documents())


# ---- vectors ----
@register("v1_cosine_similarity", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM scored")
def v1(t: Tables) -> DataFrame:
    return _pairs(t).select("query_id", "chunk_id", six("similarity").alias("similarity"))


V2 = "SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) AS INTEGER) AS rank, chunk_id, round(similarity, 6) AS similarity FROM scored WHERE similarity >= {least} QUALIFY rank <= {k}"


@register("v2_similarity_search", V2.format(least=0.1, k=25))
def v2(t: Tables) -> DataFrame:
    return vector.similarity_search(t.queries(), t.document_chunks(), t.knowledge_documents()).select("query_id", "rank", "chunk_id", six("similarity").alias("similarity"))


@register("v2_bulk_similarity_search", V2.format(least=0.1, k=25))
def v2b(t: Tables) -> DataFrame:
    return vector.bulk_similarity_search(t.queries(), t.document_chunks(), t.knowledge_documents()).select("query_id", "rank", "chunk_id", six("similarity").alias("similarity"))


def _v3(t: Tables) -> DataFrame:
    return rerank.search_variations(t.variations(), t.document_chunks(), t.knowledge_documents())


def _v4(t: Tables) -> DataFrame:
    return rerank.threshold_and_cap(_v3(t), 0.22)


def _v5(t: Tables) -> DataFrame:
    return rerank.boost_keywords(_v4(t), t.queries())


def _v6(t: Tables) -> DataFrame:
    return rerank.diversify_by_document(_v5(t), 4)


def _v8(t: Tables) -> DataFrame:
    return rerank.add_context(_v6(t), t.document_chunks(), t.knowledge_documents())


def _v10(t: Tables) -> DataFrame:
    return rerank.token_budget(rerank.format_results(_v8(t)), 3000)


def _hit(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", six("similarity").alias("similarity"), *more)


@register("v3_search_variations", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, variation_no FROM v3")
def v3(t: Tables) -> DataFrame:
    return _hit(_v3(t), "variation_no")


@register("v4_threshold_and_cap", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM v4")
def v4(t: Tables) -> DataFrame:
    return _hit(_v4(t))


@register("v5_boost_keywords", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, round(keyword_boost, 6) AS boost FROM v5")
def v5(t: Tables) -> DataFrame:
    return _hit(_v5(t).withColumn("boost", six("keyword_boost")), "boost")


@register("v6_diversify_by_document", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity FROM v6")
def v6(t: Tables) -> DataFrame:
    return _hit(_v6(t))


@register("v7_adjacent_chunks", "SELECT query_id, chunk_id, neighbour_id, CAST(distance AS INTEGER) AS distance FROM v7")
def v7(t: Tables) -> DataFrame:
    return rerank.adjacent_chunks(_v6(t), t.document_chunks(), t.knowledge_documents()).select("query_id", "chunk_id", "neighbour_id", "distance")


@register("v8_add_context", "SELECT query_id, chunk_id, round(similarity, 6) AS similarity, result_id, is_context FROM v8")
def v8(t: Tables) -> DataFrame:
    return _hit(_v8(t), "result_id", "is_context")


RESULT = "query_id, rank, result_id, content, similarity, document, document_id, section, relevance, keyword_boost, content_length, original_length, preview"


@register("v9_format_results", f"SELECT {RESULT} FROM v9")
def v9(t: Tables) -> DataFrame:
    return rerank.format_results(_v8(t)).select(*RESULT.split(", "))


@register("v10_token_budget", "SELECT query_id, rank, result_id, tokens FROM v10")
def v10(t: Tables) -> DataFrame:
    return _v10(t).select("query_id", "rank", "result_id", "tokens")


@register("v11_result_stats", """SELECT query_id, n AS total_results, coalesce(a, 0) AS actual_results, coalesce(tt, 0) AS total_tokens, coalesce(tc, 0) AS total_chars, CASE WHEN a > 0 THEN CAST(floor(tt / a + 0.5) AS BIGINT) ELSE 0 END AS average_tokens,
    CASE WHEN tc > 0 THEN floor(tt / tc * 100 + 0.5) / 100 ELSE 0 END AS token_char_ratio, CAST(floor(coalesce(tt, 0) / 12000 * 100 + 0.5) AS BIGINT) AS budget_used, coalesce(tr, 0) AS truncated_results
    FROM (SELECT query_id, count(*) AS n FROM v9 GROUP BY 1) LEFT JOIN (SELECT query_id, count(*) AS a, CAST(sum(tokens) AS BIGINT) AS tt, CAST(sum(content_length) AS BIGINT) AS tc, count(*) FILTER (original_length > content_length) AS tr FROM v10 GROUP BY 1) USING (query_id)""")
def v11(t: Tables) -> DataFrame:
    all_ = rerank.format_results(_v8(t))
    return rerank.result_stats(rerank.token_budget(all_, 3000), all_)


@register("v12_search_summary", """SELECT a.query_id, CASE WHEN n IS NULL THEN 'No relevant content found for "' || text || '" in the user''s knowledge base.' ELSE
    'Found ' || n || ' relevant result' || CASE WHEN n = 1 THEN '' ELSE 's' END || ' for "' || text || '"' ||
    CASE WHEN len(d) = 1 THEN ' from the document "' || d[1] || '"' ELSE ' across ' || len(d) || ' documents: ' || array_to_string(d[1:3], ', ') || CASE WHEN len(d) > 3 THEN '...' ELSE '' END END ||
    CASE WHEN h > 0 THEN '. ' || h || CASE WHEN h = 1 THEN ' result is' ELSE ' results are' END || ' highly relevant' || CASE WHEN v > h THEN ' and ' || (v - h) || ' additional' || CASE WHEN v - h = 1 THEN ' result is' ELSE ' results are' END || ' very relevant' ELSE '' END || '.'
    WHEN v > 0 THEN '. ' || v || CASE WHEN v = 1 THEN ' result is' ELSE ' results are' END || ' very relevant.' ELSE '' END END AS summary
    FROM asked a LEFT JOIN (SELECT query_id, n, h, v, list_filter(l, lambda x, i: list_position(l, x) = i) AS d FROM (SELECT query_id, count(*) AS n, list(document ORDER BY rank) AS l, count(*) FILTER (similarity >= 0.6) AS h, count(*) FILTER (similarity >= 0.45) AS v FROM v10 GROUP BY 1)) USING (query_id)""")
def v12(t: Tables) -> DataFrame:
    return rerank.search_summary(t.queries(), _v10(t))


@register("v10_token_budget_words", """SELECT query_id, rank, result_id, tokens FROM (SELECT *, sum(tokens) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t
    FROM (SELECT query_id, rank, result_id, len(regexp_extract_all(content, '[A-Za-z0-9]+')) AS tokens FROM v9)) WHERE t <= 200""")
def v10b(t: Tables) -> DataFrame:
    """A budget by another count of tokens, small enough to cut."""
    words = lambda c: F.regexp_count(c, F.lit("[A-Za-z0-9]+")).cast("long")
    return rerank.token_budget(rerank.format_results(_v8(t)), max_tokens=200, count_tokens=words).select("query_id", "rank", "result_id", "tokens")


@register("v13_fixed_floor", f"SELECT {RESULT}, tokens FROM v10", results=10)
def v13b(t: Tables) -> DataFrame:
    return rerank.search_pipeline(t.queries(), t.variations(), t.document_chunks(), t.knowledge_documents(), 10, 0.22, 3000, dynamic=False).select(*RESULT.split(", "), "tokens")


@register("v13_search_pipeline", f"SELECT {RESULT}, tokens FROM v10", results=10, floor=S.DYNAMIC)
def v13(t: Tables) -> DataFrame:
    return rerank.search_pipeline(t.queries(), t.variations(), t.document_chunks(), t.knowledge_documents(), 10, 0.22, 3000).select(*RESULT.split(", "), "tokens")


@register("v14_retrieve_batch", "SELECT query_id, rank, chunk_id, round(similarity, 6) AS score, content, coalesce(title, 'Unknown Document') AS title FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) AS INTEGER) AS rank FROM scored WHERE similarity >= 0.3) WHERE rank <= 5")
def v14(t: Tables) -> DataFrame:
    return vector.retrieve_batch(t.queries(), t.document_chunks(), t.knowledge_documents(), 5, 0.3).withColumn("score", six("score"))


_BEFORE, _REST = rerank.PROMPT.replace("'", "''").split("{context}")
_MIDDLE, _AFTER = _REST.split("{question}")


@register("v15_build_rag_prompts", f"""SELECT query_id, '{_BEFORE}' || coalesce(context, '') || '{_MIDDLE}' || text || '{_AFTER}' AS prompt FROM asked LEFT JOIN (SELECT query_id, string_agg(content, chr(10) || chr(10) ORDER BY rank) AS context
    FROM (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) AS rank FROM scored WHERE similarity >= 0.3) WHERE rank <= 5 GROUP BY 1) USING (query_id)""")
def v15(t: Tables) -> DataFrame:
    return rerank.build_rag_prompts(t.queries(), vector.retrieve_batch(t.queries(), t.document_chunks(), t.knowledge_documents(), 5, 0.3))


@register("v16_similarity_profile", """SELECT query_id, floor(max(similarity) * 1000 + 0.5) / 1000 AS max_similarity, floor(min(similarity) * 1000 + 0.5) / 1000 AS min_similarity, floor(avg(similarity) * 1000 + 0.5) / 1000 AS avg_similarity,
    count(*) FILTER (similarity >= 0.4) AS over_40, count(*) FILTER (similarity >= 0.3) AS over_30, count(*) FILTER (similarity >= 0.2) AS over_20, array_to_string(list(chunk_id ORDER BY similarity DESC, chunk_id)[1:10], ',') AS top_chunks FROM scored GROUP BY 1""")
def v16(t: Tables) -> DataFrame:
    return vector.similarity_profile(t.queries(), t.document_chunks(), t.knowledge_documents())


@register("v17_threshold_sweep", f"""SELECT query_id, setting, count(chunk_id) FILTER (similarity >= floor_) AS results, arg_min(chunk_id, rank) FILTER (similarity >= floor_) AS best_chunk FROM (
    SELECT query_id, setting, CASE WHEN dyn THEN {S.threshold('text', 'least_')} ELSE least_ END AS floor_ FROM asked, (VALUES (1, 0.4::DOUBLE, true), (2, 0.3::DOUBLE, false), (3, 0.2::DOUBLE, false)) AS s(setting, least_, dyn))
    LEFT JOIN (SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, document_id, chunk_index, chunk_id) AS rank FROM scored WHERE similarity >= 0.1 QUALIFY rank <= 10) USING (query_id) GROUP BY ALL""")
def v17(t: Tables) -> DataFrame:
    return vector.threshold_sweep(t.queries(), t.document_chunks(), t.knowledge_documents(), [(1, 0.4, True), (2, 0.3, False), (3, 0.2, False)])


@register("v18_approx_search")
def v18(t: Tables) -> DataFrame:
    chunks = t.document_chunks()
    return vector.approx_search(t.queries(), chunks, t.knowledge_documents(), vector.train_lists(chunks, 16), probes=13)


@register("v18_recall")
def v18b(t: Tables) -> DataFrame:
    """Recall per query against the exact search, at a tenth of 100 lists (the defaults), and at what v18 probes."""
    q, chunks, docs = t.queries(), t.document_chunks(), t.knowledge_documents()
    exact = vector.similarity_search(q, chunks, docs, 10).select("query_id", "chunk_id")
    at = [(100, 10), (16, 13)]
    each = [vector.search_recall(vector.approx_search(q, chunks, docs, vector.train_lists(chunks, n), probes=k), exact).withColumns({"lists": F.lit(n), "probes": F.lit(k)}) for n, k in at]
    return each[0].unionByName(each[1])


@register("v18_quantised_search")
def v18c(t: Tables) -> DataFrame:
    """The best ten by codes of 32 bytes and twelve exact vectors a query."""
    return _quantised(t)


def _quantised(t: Tables, **how) -> DataFrame:
    chunks, docs = t.document_chunks(), t.knowledge_documents()
    books = quantise.train_codebooks(chunks, 16, 32)
    index = quantise.encode_chunks(chunks, books)
    return quantise.quantised_search(t.queries(), index, chunks, docs, books, **({"probes": 16, "candidates": 12} | how))


@register("v18_quantised_recall")
def v18d(t: Tables) -> DataFrame:
    """Per query: recall of the ten best against the exact search, and the share of its user's vectors that were read."""
    q, chunks, docs = t.queries(), t.document_chunks(), t.knowledge_documents()
    exact = vector.similarity_search(q, chunks, docs, 10).select("query_id", "chunk_id")
    owned = chunks.join(docs.select(F.col("id").alias("document_id"), "user_id"), "document_id").groupBy("user_id").agg(F.count(F.lit(1)).alias("vectors"))
    share = q.select("query_id", "user_id").join(owned, "user_id").select("query_id", (F.lit(12) / F.col("vectors")).alias("read"))
    return vector.search_recall(_quantised(t), exact).join(share, "query_id")


@register("v18_quantised_exhaustive", V2.format(least=0.1, k=10))
def v18e(t: Tables) -> DataFrame:
    """With every list and every candidate it is the exact search."""
    return _quantised(t, candidates=1 << 30).select("query_id", "rank", "chunk_id", six("similarity").alias("similarity"))


@register("v19_tune_search_params", """SELECT user_id, vectors, lists, probes, vectors * 0.1::DOUBLE * probes / lists AS estimated_ms FROM (SELECT *, greatest(1, least(100, CAST(ceil(lists * (1 - 0.9::DOUBLE) * 2) AS BIGINT))) AS probes FROM (
    SELECT user_id, count(*) AS vectors, greatest(10, least(1000, count(*) // 1000)) AS lists FROM chunks c JOIN kd d ON d.id = c.document_id GROUP BY 1))""")
def v19(t: Tables) -> DataFrame:
    return vector.tune_search_params(t.document_chunks(), t.knowledge_documents())


# ---- history ----
@register("h1_chat_history_page", """SELECT id, user_id, CAST(position AS INTEGER) AS position, more > 5 AS has_more FROM (SELECT *, max(least(position, 6)) OVER (PARTITION BY user_id) AS more FROM (SELECT c.id, c.user_id, row_number() OVER (PARTITION BY c.user_id ORDER BY c.created_at DESC, c.id DESC) AS position
    FROM chats c JOIN (SELECT user_id, max(id) AS cursor_id FROM chats GROUP BY 1) k ON k.user_id = c.user_id JOIN chats x ON x.id = k.cursor_id AND c.created_at < x.created_at)) WHERE position <= 5""")
def h1(t: Tables) -> DataFrame:
    cursors = t.chats().groupBy("user_id").agg(F.max("id").alias("chat_id"))
    return history.chat_history_page(t.chats(), 5, cursors, "ending_before").select("id", "user_id", "position", "has_more")


@register("h2_messages_by_chat", "SELECT id, chat_id, CAST(row_number() OVER (PARTITION BY chat_id ORDER BY created_at, id) AS INTEGER) AS position FROM messages")
def h2(t: Tables) -> DataFrame:
    return history.messages_by_chat(t.messages(), t.chats().select(F.col("id").alias("chat_id"))).select("id", "chat_id", "position")


@register("h3_last_messages", "SELECT chat_id, arg_max(id, created_at) FILTER (role = 'user') AS last_user_message, arg_max(id, created_at) AS trailing_message FROM messages GROUP BY 1")
def h3(t: Tables) -> DataFrame:
    return history.last_messages(t.messages())


@register("h4_latest_version", "SELECT id, content FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at DESC) = 1")
def h4(t: Tables) -> DataFrame:
    return history.latest_version(t.doc_versions()).select("id", "content")


@register("h4_all_versions", "SELECT id, CAST(created_at AS VARCHAR) AS created_at, CAST(row_number() OVER (PARTITION BY id ORDER BY created_at) - 1 AS INTEGER) AS version FROM versions")
def h4b(t: Tables) -> DataFrame:
    return times(history.all_versions(t.doc_versions()).select("id", "created_at", "version"), "created_at")


@register("h4_version_at", "SELECT id, CAST(created_at AS VARCHAR) AS created_at FROM versions QUALIFY row_number() OVER (PARTITION BY id ORDER BY created_at) = 2")
def h4c(t: Tables) -> DataFrame:
    return times(history.version_at(t.doc_versions(), 1), "created_at")


@register("h5_list_documents", "SELECT id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS position, file_url IS NOT NULL AS has_file_url FROM kd QUALIFY position BETWEEN 11 AND 60")
def h5(t: Tables) -> DataFrame:
    return history.list_documents(t.knowledge_documents(), 50, 10).select("id", "user_id", "position", "has_file_url")


@register("h6_user_chunks", "SELECT c.id, c.document_id, c.chunk_index, d.user_id, d.title FROM chunks c JOIN kd d ON d.id = c.document_id")
def h6(t: Tables) -> DataFrame:
    return history.user_chunks(t.document_chunks(), t.knowledge_documents()).select("id", "document_id", "chunk_index", "user_id", "title")


@register("h7_chunks_batch", "SELECT c.id, c.document_id, d.title, CAST(row_number() OVER (PARTITION BY c.document_id ORDER BY chunk_index) AS INTEGER) AS position FROM chunks c JOIN kd d ON d.id = c.document_id WHERE c.id IN (SELECT query_id FROM asked)")
def h7(t: Tables) -> DataFrame:
    ids = t.queries().select(F.col("query_id").alias("id"))
    return history.chunks_batch(t.document_chunks(), t.knowledge_documents(), ids).select("id", "document_id", "title", "position")


@register("h8_has_documents", "SELECT id AS user_id, id IN (SELECT user_id FROM kd) AS has_documents FROM users")
def h8(t: Tables) -> DataFrame:
    return history.has_documents(t.users(), t.knowledge_documents())


@register("h9_chat_date_bucket", f"""SELECT id, CASE WHEN CAST(created_at AS DATE) = DATE '2024-01-05' THEN 'today' WHEN CAST(created_at AS DATE) = DATE '2024-01-04' THEN 'yesterday' WHEN created_at > {S.NOW_CHATS} - INTERVAL 7 DAY THEN 'lastWeek' WHEN created_at > {S.NOW_CHATS} - INTERVAL 1 MONTH THEN 'lastMonth' ELSE 'older' END AS bucket
    FROM (SELECT id, created_at - to_days(CAST(id % 50 AS INTEGER)) AS created_at FROM chats)""")
def h9(t: Tables) -> DataFrame:
    c = t.chats().withColumn("created_at", F.col("created_at") - F.make_dt_interval(days=(F.col("id") % 50).cast("int")))
    return c.select("id", history.chat_date_bucket(F.col("created_at"), now(False)).alias("bucket"))


@register("h10_votes_by_chat", "SELECT chat_id, message_id, is_upvoted FROM votes")
def h10(t: Tables) -> DataFrame:
    return history.rows_of(t.votes(), t.chats().select(F.col("id").alias("chat_id")), "chat_id").select("chat_id", "message_id", "is_upvoted")


@register("h10_suggestions_by_document", "SELECT id, document_id, original_text FROM suggestions")
def h10b(t: Tables) -> DataFrame:
    return history.rows_of(t.suggestions(), t.chats().select(F.col("id").alias("document_id")), "document_id").select("id", "document_id", "original_text")


@register("h11_authorize", "SELECT event_id AS request_id, CASE WHEN c.id IS NULL THEN 'not_found' WHEN c.user_id = e.user_id % 15 THEN 'ok' ELSE 'forbidden' END AS status FROM events e LEFT JOIN chats c ON c.id = e.event_id % 700")
def h11(t: Tables) -> DataFrame:
    asked = t.raw("events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 15).alias("user_id"), (F.col("event_id") % 700).alias("id"))
    return history.authorize(asked, t.chats().select("id", F.col("user_id").alias("owner_id")))


@register("h12_locate_suggestions", """SELECT s.id AS suggestion_id, CASE WHEN p > 0 THEN p - 1 ELSE 0 END AS start_at, CASE WHEN p > 0 THEN p - 1 + length(original_text) ELSE 0 END AS end_at FROM (
    SELECT s.id, original_text, strpos(content, original_text) AS p FROM suggestions s JOIN versions v ON v.id = s.document_id AND v.created_at = s.document_created_at) s""")
def h12(t: Tables) -> DataFrame:
    return history.locate_suggestions(t.suggestions(), t.doc_versions())


# ---- statistics ----
@register("a1_document_stats", "SELECT d.id AS document_id, user_id, title, coalesce(n, 0) AS chunk_count, round(chars / n, 6) AS avg_chunk_length, CAST(first AS VARCHAR) AS first_chunk_date, CAST(last AS VARCHAR) AS last_chunk_date FROM kd d LEFT JOIN doc_sizes s ON s.document_id = d.id")
def a1(t: Tables) -> DataFrame:
    return times(stats.document_stats(t.knowledge_documents(), t.document_chunks()).drop("file_type").withColumn("avg_chunk_length", six("avg_chunk_length")), "first_chunk_date", "last_chunk_date")


@register("a2_knowledge_base_size", "SELECT user_id, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS characters, CAST(floor(sum(chars) / sum(n) + 0.5) AS BIGINT) AS avg_chunk_length, CAST(coalesce(sum(n), 0) * 6144 AS BIGINT) AS vector_bytes FROM kd d LEFT JOIN doc_sizes s ON s.document_id = d.id GROUP BY 1")
def a2(t: Tables) -> DataFrame:
    return stats.knowledge_base_size(t.knowledge_documents(), t.document_chunks())


#: Chunks after three batches of changes: what stays.
_LEFT = "SELECT * FROM chunks WHERE NOT (id % 4 = 1 AND id % 3 <> 0) AND NOT (id % 5 IN (0, 4) AND document_id % 3 = 0) AND document_id % 11 <> 0"
_LEFT_SIZES = f"SELECT document_id, count(*) AS n, sum(length(content)) AS chars, min(created_at) AS first, max(created_at) AS last FROM ({_LEFT}) GROUP BY 1"


def _kept_up(t: Tables) -> DataFrame:
    """Sums per document after chunks came and went in three batches, each merged into what was there."""
    root = stream_dir(t)
    c = t.document_chunks().drop("embedding")
    schema = "id long, document_id long, chunk_index int, content string, created_at timestamp_ntz"
    chunks, sums = BucketTable(t.spark, f"{root}/chunks", schema, "document_id"), BucketTable(t.spark, f"{root}/sums", stats.SUMS, "document_id")
    gone = ["id % 4 = 1 and id % 3 <> 0", "id % 5 in (0, 4) and document_id % 3 = 0", "document_id % 11 = 0"]
    batches = [(c.filter("id % 3 <> 0"), c.limit(0)), (c.filter("id % 3 = 0"), c.filter(gone[0])), (c.limit(0), c.filter(f"({gone[1]} or {gone[2]}) and not ({gone[0]})"))]
    for added, removed in batches:
        stats.change_chunks(chunks, added, removed)
        stats.refresh_sums(sums, added, removed, chunks)
    return sums.read()


@register("a1_kept_up_stats", f"SELECT d.id AS document_id, user_id, title, coalesce(n, 0) AS chunk_count, round(chars / n, 6) AS avg_chunk_length, CAST(first AS VARCHAR) AS first_chunk_date, CAST(last AS VARCHAR) AS last_chunk_date FROM kd d LEFT JOIN ({_LEFT_SIZES}) s ON s.document_id = d.id")
def a1b(t: Tables) -> DataFrame:
    return times(stats.stats_of_sums(t.knowledge_documents(), _kept_up(t)).drop("file_type").withColumn("avg_chunk_length", six("avg_chunk_length")), "first_chunk_date", "last_chunk_date")


@register("a2_kept_up_size", f"SELECT user_id, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks, CAST(sum(chars) AS BIGINT) AS characters, CAST(floor(sum(chars) / sum(n) + 0.5) AS BIGINT) AS avg_chunk_length, CAST(coalesce(sum(n), 0) * 6144 AS BIGINT) AS vector_bytes FROM kd d LEFT JOIN ({_LEFT_SIZES}) s ON s.document_id = d.id GROUP BY 1")
def a2b(t: Tables) -> DataFrame:
    return stats.size_of_sums(t.knowledge_documents(), _kept_up(t))


@register("a3_table_counts", "SELECT user_id, count(*) AS documents, CAST(coalesce(sum(n), 0) AS BIGINT) AS chunks FROM kd d LEFT JOIN doc_sizes s ON s.document_id = d.id GROUP BY 1 UNION ALL SELECT NULL, (SELECT count(*) FROM kd), (SELECT count(*) FROM chunks)")
def a3(t: Tables) -> DataFrame:
    return stats.table_counts(t.knowledge_documents(), t.document_chunks())


RECENT = f"SELECT c.user_id, count(*) AS n FROM messages m JOIN chats c ON c.id = m.chat_id WHERE role = 'user' AND m.created_at >= {S.NOW_CHATS} - INTERVAL 24 HOUR GROUP BY 1"


@register("a4_message_count", f"SELECT user_id, n AS messages FROM ({RECENT})")
def a4(t: Tables) -> DataFrame:
    return stats.message_count(t.messages(), t.chats(), now(False))


@register("a5_quota_status", f"SELECT id AS user_id, kind AS user_type, q AS quota, coalesce(n, 0) AS messages, coalesce(n, 0) > q AS exceeded FROM (SELECT id, CASE WHEN email LIKE 'guest-%' THEN 'guest' ELSE 'regular' END AS kind, CASE WHEN email LIKE 'guest-%' THEN 20 ELSE 100 END AS q FROM users) u LEFT JOIN ({RECENT}) r ON r.user_id = u.id")
def a5(t: Tables) -> DataFrame:
    return stats.quota_status(t.users(), t.messages(), t.chats(), now(False))


@register("a6_search_summary_stats", f"""SELECT s.user_id, round(avg(execution_time_ms), 6) AS avg_ms, count(*) AS searches, round(count(c.query_hash) * 100.0::DOUBLE / count(*), 6) AS cache_hit_rate, round(avg(result_count), 6) AS avg_results
    FROM search_stats s LEFT JOIN (SELECT DISTINCT user_id, query_hash FROM query_cache) c ON c.user_id = s.user_id AND c.query_hash = s.query_hash WHERE s.created_at > {S.NOW_EVENTS} - INTERVAL 7 DAY GROUP BY 1""")
def a6(t: Tables) -> DataFrame:
    out = stats.search_summary_stats(t.search_stats(), t.query_cache(), now())
    return out.withColumns({c: six(c) for c in ("avg_ms", "cache_hit_rate", "avg_results")})


@register("a7_group_chunks_by_document", "SELECT document_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY chunk_index, id) AS chunk_ids, count(*) AS chunks FROM chunks GROUP BY 1")
def a7(t: Tables) -> DataFrame:
    return stats.group_chunks_by_document(t.document_chunks())


# ---- merges and deletes ----
@register("m1_upsert_votes", "SELECT chat_id, message_id, is_upvoted FROM (SELECT * FROM votes UNION ALL SELECT * FROM new_votes) QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ts DESC) = 1")
def m1(t: Tables) -> DataFrame:
    return history.upsert_votes(t.votes(), t.new_votes()).select("chat_id", "message_id", "is_upvoted")


@register("m2_delete_chats", "SELECT 'chat' AS kind, id FROM chats WHERE id % 3 <> 0 UNION ALL SELECT 'message', id FROM messages WHERE chat_id % 3 <> 0 UNION ALL SELECT 'vote', message_id FROM votes WHERE chat_id % 3 <> 0")
def m2(t: Tables) -> DataFrame:
    ids = t.chats().filter("id % 3 = 0").select(F.col("id").alias("chat_id"))
    c, m, v = history.delete_chats(t.chats(), t.messages(), t.votes(), ids)
    return history.union_all(c.select(F.lit("chat").alias("kind"), "id"), m.select(F.lit("message").alias("kind"), "id"), v.select(F.lit("vote").alias("kind"), F.col("message_id").alias("id")))


@register("m3_truncate_messages", """SELECT 'message' AS kind, id FROM messages m LEFT JOIN cutoffs k USING (chat_id) WHERE ts IS NULL OR created_at < ts UNION ALL SELECT 'vote', message_id FROM votes v LEFT JOIN cutoffs k ON k.chat_id = v.chat_id WHERE k.ts IS NULL OR v.ts < k.ts""")
def m3(t: Tables) -> DataFrame:
    cut = t.messages().filter("chat_id % 3 = 0 and role = 'user'").groupBy("chat_id").agg(F.max("created_at").alias("ts"))
    m, v = history.truncate_messages(t.messages(), t.votes(), cut)
    return m.select(F.lit("message").alias("kind"), "id").unionByName(v.select(F.lit("vote").alias("kind"), F.col("message_id").alias("id")))


@register("m4_truncate_versions", f"""SELECT CASE WHEN turn > 0 THEN 'removed' ELSE 'version' END AS kind, id * 100 + turn AS id FROM versions WHERE id % 3 = 0 UNION ALL SELECT 'version', id * 100 + turn FROM versions WHERE id % 3 <> 0
    UNION ALL SELECT 'suggestion', id FROM suggestions WHERE document_id % 3 <> 0 OR id % 100 = 0""")
def m4(t: Tables) -> DataFrame:
    v = t.doc_versions()
    cut = v.filter("id % 3 = 0").groupBy("id").agg(F.min("created_at").alias("ts"))
    left, s, gone = history.truncate_versions(v, t.suggestions(), cut)
    code = F.col("id") * 100 + F.minute("created_at")
    return history.union_all(left.select(F.lit("version").alias("kind"), code.alias("id")), gone.select(F.lit("removed").alias("kind"), code.alias("id")), s.select(F.lit("suggestion").alias("kind"), "id"))


@register("m5_delete_documents", "SELECT 'document' AS kind, id FROM kd WHERE NOT (id % 5 = 0 AND id % 2 = user_id % 2 AND user_id = 0) UNION ALL SELECT 'chunk', id FROM chunks WHERE document_id NOT IN (SELECT id FROM kd WHERE id % 5 = 0 AND user_id = 0)")
def m5(t: Tables) -> DataFrame:
    asked = t.knowledge_documents().filter("id % 5 = 0").select("id", F.lit(0).cast("long").alias("user_id"))
    d, c = history.delete_documents(t.knowledge_documents(), t.document_chunks(), asked)
    return d.select(F.lit("document").alias("kind"), "id").unionByName(c.select(F.lit("chunk").alias("kind"), "id"))


@register("m6_orphan_chunks", "SELECT id, document_id FROM orphan_input WHERE document_id NOT IN (SELECT id FROM kd)")
def m6(t: Tables) -> DataFrame:
    return stats.orphan_chunks(t.orphans(), t.knowledge_documents()).select("id", "document_id")


@register("m6_drop_orphans", "SELECT id, document_id FROM orphan_input WHERE document_id IN (SELECT id FROM kd)")
def m6b(t: Tables) -> DataFrame:
    return stats.drop_orphans(t.orphans(), t.knowledge_documents()).select("id", "document_id")


MERGED = "SELECT user_id, query_hash, coalesce(w.last, c.created_at) AS created_at, coalesce(w.last + INTERVAL 1 HOUR, c.expires_at) AS expires_at, coalesce(hit_count, 0) + coalesce(n, 0) AS hit_count FROM query_cache c FULL JOIN (SELECT user_id, query_hash, max(ts) AS last, count(*) AS n FROM cache_writes GROUP BY ALL) w USING (user_id, query_hash)"


@register("m7_cache_merge", f"SELECT user_id, query_hash, CAST(created_at AS VARCHAR) AS created_at, CAST(expires_at AS VARCHAR) AS expires_at, hit_count FROM ({MERGED})")
def m7(t: Tables) -> DataFrame:
    return times(stats.cache_merge(t.query_cache(), t.cache_writes()), "created_at", "expires_at")


_NOW = "TIMESTAMP '2024-01-15 12:00:00'"


def _mid() -> Column:
    return F.expr("timestamp_ntz'2024-01-15 12:00:00'")


@register("m8_cache_lookup", f"SELECT user_id, query_hash, hit_count, false AS is_expired FROM query_cache WHERE expires_at > {_NOW} AND (user_id, query_hash) IN (SELECT (user_id, query_hash) FROM cache_writes)")
def m8(t: Tables) -> DataFrame:
    return stats.cache_lookup(t.query_cache(), t.cache_writes().select("user_id", "query_hash").distinct(), _mid()).select("user_id", "query_hash", "hit_count", "is_expired")


@register("m9_cache_expire", f"SELECT user_id, query_hash FROM query_cache WHERE expires_at >= {_NOW}")
def m9(t: Tables) -> DataFrame:
    return stats.cache_expire(t.query_cache(), _mid()).select("user_id", "query_hash")


@register("m10_maintenance", f"SELECT 'expired_cache_entries' AS task, (SELECT count(*) FROM query_cache WHERE expires_at < {_NOW}) AS n UNION ALL SELECT 'orphan_chunks', (SELECT count(*) FROM orphan_input WHERE document_id NOT IN (SELECT id FROM kd)) UNION ALL SELECT 'document_stats', (SELECT count(*) FROM kd)")
def m10(t: Tables) -> DataFrame:
    return stats.maintenance(t.knowledge_documents(), t.orphans(), t.query_cache(), _mid())


@register("m11_set_visibility", "SELECT id, CASE WHEN id % 5 = 0 THEN 'public' ELSE visibility END AS visibility FROM chats")
def m11(t: Tables) -> DataFrame:
    changes = t.chats().filter("id % 5 = 0").select("id", F.lit("public").alias("new_visibility"))
    return history.set_visibility(t.chats(), changes).select("id", "visibility")


@register("m12_distinct_by_prefix", "SELECT id FROM chunks QUALIFY row_number() OVER (PARTITION BY substr(content, 1, 100) ORDER BY id) = 1")
def m12(t: Tables) -> DataFrame:
    return rerank.distinct_by_prefix(t.document_chunks(), [], ["id"]).select("id")


# ---- migration ----
@register("g1_message_rank", "SELECT DISTINCT id, rank FROM old_parts")
def g1(t: Tables) -> DataFrame:
    return t.old_messages().select("id", migrate.message_rank(F.col("role"), migrate.parts_of(F.col("content"))).alias("rank"))


@register("g2_message_sections", "SELECT id, chat_id, CAST(section AS BIGINT) AS section FROM ranked_messages")
def g2(t: Tables) -> DataFrame:
    return migrate.message_sections(t.old_messages()).select("id", "chat_id", "section")


#: A part's type and its content, or the whole part.
_KEY = """regexp_extract(p.part, '"type":"([^"]+)"\\}$', 1) || '|' || coalesce(CAST(json_extract(p.part, '$.content') AS VARCHAR), p.part)"""


@register("g3_dedupe_parts", f"SELECT id, '[' || string_agg(p.part, ',' ORDER BY p.k) || ']' AS parts FROM (SELECT id, p FROM old_parts QUALIFY row_number() OVER (PARTITION BY id, {_KEY} ORDER BY p.k) = 1) GROUP BY id")
def g3(t: Tables) -> DataFrame:
    return t.old_messages().select("id", migrate.parts_json(migrate.dedupe_parts(migrate.parts_of(F.col("content")))).alias("parts"))


@register("g4_drop_undefined_reasoning", """SELECT id, '[' || string_agg(p.part, ',' ORDER BY p.k) || ']' AS parts FROM old_parts WHERE p.part <> '{"reasoning":"undefined","type":"reasoning"}' GROUP BY id""")
def g4(t: Tables) -> DataFrame:
    return t.old_messages().select("id", migrate.parts_json(migrate.drop_undefined_reasoning(migrate.parts_of(F.col("content")))).alias("parts"))


@register("g5_migrate_messages", f"""SELECT id, chat_id, role, CAST(created_at AS VARCHAR) AS created_at, '[' || p.part || ']' AS parts, 0 AS attachments FROM old_parts WHERE role = 'user' UNION ALL
    SELECT arg_min(id, (created_at, rank, id)) FILTER (role = 'assistant'), chat_id, 'assistant', CAST(min(created_at) AS VARCHAR), '[' || string_agg(p.part, ',' ORDER BY (created_at, rank, id, p.k)) FILTER (p.part NOT LIKE '{{"reasoning":"undefined"%') || ']', 0 FROM (
        SELECT * FROM (SELECT o.id, o.chat_id, o.role, o.created_at, o.rank, section, {{'k': p.k, 'part': CASE WHEN p.part LIKE '%"tool-call"}}' THEN replace(p.part, ',"toolCallId"', ',"result":{{"hits":[' || o.id || '],"more":null}},"toolCallId"') ELSE p.part END}} AS p
            FROM old_parts o JOIN ranked_messages USING (id) WHERE o.role = 'assistant')
        QUALIFY row_number() OVER (PARTITION BY chat_id, section, {_KEY} ORDER BY created_at, rank, id, p.k) = 1) GROUP BY chat_id, section""")
def g5(t: Tables) -> DataFrame:
    out, _ = migrate.migrate_messages(t.old_messages(), t.votes())
    return times(out.select("id", "chat_id", "role", "created_at", migrate.parts_json(F.col("parts")).alias("parts"), F.size("attachments").alias("attachments")), "created_at")


@register("g5_migrate_votes", "SELECT chat_id, message_id, is_upvoted FROM votes WHERE message_id IN (SELECT arg_min(id, (created_at, rank, id)) FROM ranked_messages WHERE role = 'assistant' GROUP BY chat_id, section)")
def g5b(t: Tables) -> DataFrame:
    return migrate.migrate_messages(t.old_messages(), t.votes())[1].select("chat_id", "message_id", "is_upvoted")


@register("g6_to_model_messages", "SELECT id, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'ai' WHEN 'system' THEN 'system' END AS model_role, content AS text, role NOT IN ('user', 'assistant', 'system') AS rejected FROM messages")
def g6(t: Tables) -> DataFrame:
    return migrate.to_model_messages(t.messages())


@register("g6_from_model_messages", "SELECT id, role, content FROM messages WHERE role IN ('user', 'assistant', 'system')")
def g6b(t: Tables) -> DataFrame:
    return migrate.from_model_messages(migrate.to_model_messages(t.messages()))


SENTENCES = "regexp_extract_all(content, '[^.!?]+[.!?]*[\\t\\n\\x0B\\f\\r ]*')"


@register("g7_split_sentences", f"SELECT id, len({SENTENCES}) AS sentences, {SENTENCES}[1] AS first FROM messages")
def g7(t: Tables) -> DataFrame:
    s = t.messages().select("id", T.split_sentences("content").alias("s"))
    return s.select("id", F.size("s").cast("long").alias("sentences"), F.get("s", F.lit(0)).alias("first"))


@register("g8_version_diff")
def g8(t: Tables) -> DataFrame:
    return migrate.version_diff(t.doc_versions())


@register("g8_version_diff_counts", f"""WITH s AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY created_at) - 1 AS version, {SENTENCES} AS s FROM versions), e AS (SELECT id, version, unnest(s) AS sentence FROM s), c AS (SELECT id, version, sentence, count(*) AS n FROM e GROUP BY ALL),
    moved AS (SELECT id, version, sentence, n AS change FROM c UNION ALL SELECT id, version + 1, sentence, -n FROM c), net AS (SELECT id, version, sentence, sum(change) AS change FROM moved GROUP BY ALL)
    SELECT net.id, net.version, CAST(sum(greatest(change, 0)) AS BIGINT) AS added, CAST(sum(greatest(-change, 0)) AS BIGINT) AS removed FROM net JOIN (SELECT id, max(version) AS last FROM s GROUP BY 1) l ON l.id = net.id WHERE net.version > 0 AND net.version <= last GROUP BY ALL""".replace("WITH s AS", "SELECT * FROM (WITH s AS") + ")")
def g8b(t: Tables) -> DataFrame:
    return migrate.version_diff_counts(t.doc_versions())


# ---- streams ----
_KEPT_TEXT = S.keep_format("text")


@register("r1_stream_ingest", f"""SELECT 'chunk' AS kind, 'doc-' || doc_id || '.' || {_SENT} AS name, CAST(i AS INTEGER) AS chunk_index, substr(clean, CAST(i * 800 + 1 AS BIGINT), 1000) AS content FROM (SELECT doc_id, {_KEPT_TEXT} AS clean FROM documents WHERE doc_id % 5 < 2),
        unnest(range(0, CASE WHEN length(clean) = 0 THEN 0 WHEN length(clean) <= 1000 THEN 1 ELSE 1 + CAST(ceil((length(clean) - 1000) / 800) AS BIGINT) END)) AS u(i)
    UNION ALL SELECT 'reject', 'doc-' || doc_id || '.' || {_SENT}, NULL, CASE doc_id % 5 WHEN 2 THEN 'Unsupported file type' WHEN 3 THEN 'Invalid EPUB file' ELSE 'No text content found' END FROM documents WHERE doc_id % 5 >= 2 OR {_KEPT_TEXT} = ''""")
def r1(t: Tables) -> DataFrame:
    root = stream_dir(t)
    files.write_files(_sent_files(t), f"{root}/sent")
    jobs.stream_ingest(t.spark, f"{root}/sent", f"{root}/out", f"{root}/checkpoint", chunk=chunking.chunk_fixed, settle=0).awaitTermination()
    chunks = t.spark.read.parquet(f"{root}/out/chunks").select(F.lit("chunk").alias("kind"), F.col("id").alias("name"), "chunk_index", "content")
    bad = t.spark.read.parquet(f"{root}/out/rejects").select(F.lit("reject").alias("kind"), "name", F.lit(None).cast("int").alias("chunk_index"), F.col("reason").alias("content"))
    return chunks.unionByName(bad)


@register("r2_stream_quota", """SELECT user_id, CAST(w AS VARCHAR) AS window_start, count(*) AS messages, count(*) > 100 AS over_limit FROM (SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS w FROM events, unnest(range(0, 24)) AS u(k) WHERE event_type IN ('view', 'click')) GROUP BY user_id, w""")
def r2(t: Tables) -> DataFrame:
    return times(stream(t, t.message_stream(), jobs.rolling_quota), "window_start").drop("window_end")


_LAST_DAY = "SELECT event_id, user_id, CAST(ts AS VARCHAR) AS ts, count(*) OVER w AS messages, count(*) OVER w > 100 AS over_limit FROM events WHERE event_type IN ('view', 'click') WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW)"


@register("r2_exact_quota", _LAST_DAY)
def r2b(t: Tables) -> DataFrame:
    return times(stream(t, t.message_stream(), windows.exact_quota), "ts")


@register("r2_exact_quota_batch", _LAST_DAY)
def r2c(t: Tables) -> DataFrame:
    return times(windows.exact_quota(t.message_stream()), "ts")


_HITS = """SELECT request_id, user_id, query_hash, CAST(ts AS VARCHAR) AS ts, EXISTS (FROM (SELECT user_id AS u, query_hash AS q, ts AS written FROM cache_writes) w WHERE u = r.user_id AND q = r.query_hash AND written <= r.ts AND written > r.ts - INTERVAL 1 HOUR) AS hit
    FROM (SELECT event_id AS request_id, user_id, md5(props) AS query_hash, ts FROM events WHERE event_type = 'view') r"""


def _requests(t: Tables) -> DataFrame:
    return t.raw("events").filter("event_type = 'view'").select(F.col("event_id").alias("request_id"), "user_id", F.md5("props").alias("query_hash"), F.col("ts").cast("timestamp").alias("ts"))


@register("r4_cache_hits", _HITS)
def r4b(t: Tables) -> DataFrame:
    writes = t.cache_writes().withColumn("ts", F.col("ts").cast("timestamp"))
    root = stream_dir(t)
    stream_file(t, writes, f"{root}/writes")
    return times(stream(t, _requests(t), lambda rows: windows.cache_hits(rows, t.spark.readStream.schema(writes.schema).parquet(f"{root}/writes"))), "ts")


@register("r4_cache_hits_batch", _HITS)
def r4c(t: Tables) -> DataFrame:
    return times(windows.cache_hits(_requests(t), t.cache_writes().withColumn("ts", F.col("ts").cast("timestamp"))), "ts")


@register("r3_stream_votes", "SELECT chat_id, message_id, is_upvoted FROM (SELECT * FROM votes UNION ALL SELECT * FROM new_votes) QUALIFY row_number() OVER (PARTITION BY chat_id, message_id ORDER BY ts DESC) = 1")
def r3(t: Tables) -> DataFrame:
    root = stream_dir(t)
    t.votes().write.parquet(f"{root}/in/a")
    t.new_votes().write.parquet(f"{root}/in/b")
    votes = t.spark.readStream.schema("chat_id long, message_id long, is_upvoted boolean, ts timestamp_ntz").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", "1000").parquet(f"{root}/in")
    table = jobs.vote_table(t.spark, f"{root}/out")
    jobs.stream_votes(votes, table, f"{root}/checkpoint").awaitTermination()
    return table.read().select("chat_id", "message_id", "is_upvoted")


@register("r4_stream_cache", """SELECT user_id, query_hash, CAST(min(ts) AS VARCHAR) AS created_at, count(*) AS hit_count FROM (SELECT *, sum(CASE WHEN ts - before < INTERVAL 1 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, query_hash ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island
    FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, query_hash ORDER BY ts) AS before FROM cache_writes)) GROUP BY user_id, query_hash, island""")
def r4(t: Tables) -> DataFrame:
    w = t.cache_writes().withColumn("ts", F.col("ts").cast("timestamp"))
    return times(stream(t, w, jobs.cache_sessions), "created_at").drop("expires_at")


@register("r5_stream_search_stats", "SELECT user_id, CAST(date_trunc('day', created_at) AS VARCHAR) AS day, round(avg(execution_time_ms), 6) AS avg_ms, count(*) AS searches, round(avg(result_count), 6) AS avg_results FROM search_stats GROUP BY user_id, date_trunc('day', created_at)")
def r5(t: Tables) -> DataFrame:
    s = t.search_stats().withColumn("ts", F.col("created_at").cast("timestamp")).drop("created_at")
    return times(stream(t, s, jobs.daily_search_stats), "day").withColumns({c: six(c) for c in ("avg_ms", "avg_results")})


@register("r6_stream_dedupe_events", "SELECT event_id, user_id FROM events")
def r6(t: Tables) -> DataFrame:
    e = t.message_stream()
    return stream(t, e.unionByName(e.filter("event_id % 3 = 0")), jobs.dedupe_events).select("event_id", "user_id")
