"""Small cases with known answers."""

import datetime
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from docfold.functions import text as T
from docfold.operators import chunking, embedding, history, migrate, rerank, vector
from docfold.sources import files
from docfold.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    "query, threshold",
    [
        ("deep learning", 0.18), ("deep learning for all", 0.20), ("deep learning for all of us", 0.22), ("one two three four five six seven eight", 0.27), ("what is deep learning", 0.18),
        ("what one two three four five six seven", 0.22), ('what is "deep" learning', 0.16), ('one "two" three', 0.16), ('one "two" three four five six seven eight', 0.20), ('what "one" two three four five six seven', 0.16),
    ],
)
def test_thresholds(spark, query, threshold):
    assert one(spark, T.dynamic_threshold(F.lit(query), 0.22)) == pytest.approx(threshold)


def test_text_functions(spark):
    assert one(spark, T.sanitize_keep_format(F.lit("a\x00b\r\nc\rd\n\n\n\n\ne\x07 "))) == "ab\nc\nd\n\n\ne"
    assert one(spark, T.sanitize_keep_format(F.lit(None).cast("string"))) == ""
    assert one(spark, T.html_to_text(F.lit("<p>a &amp;lt; b</p><script>x</script><br>c"))) == "a < b c"
    assert one(spark, T.format_bytes(F.lit(1024))) == "1 KB"
    assert one(spark, T.format_bytes(F.lit(0))) == "0 Bytes"
    assert one(spark, T.format_bytes(F.lit(1536))) == "1.5 KB"
    assert one(spark, T.blob_folder(F.lit("attachment"), F.lit(None).cast("string"))) == "attachments"
    assert one(spark, T.blob_folder(F.lit("artifact"), F.lit("user456"))) == "artifacts/user456"
    assert one(spark, T.extract_keywords(F.lit("What's the \"Data\" of data, science?"))) == ["whats", "data", "of", "data", "science"]
    assert one(spark, T.repair_spaced_letters(F.lit("D a t a S c i e n c e is fun"))).split()[:2] == ["data", "science"]
    p = one(spark, T.text_problems(F.lit("a\x07b\x01c\x07")))
    assert (p.has_null_bytes, p.control_chars, p.problem_chars, p.is_safe) == (False, 3, ["\x07", "\x01"], False)


def test_file_rules(spark):
    names = {"book.epub": "epub", "book.EPUB": "epub", "book.pdf": "pdf", "book.txt": "txt", "book.unknown": None, "book": None}
    for name, kind in names.items():
        assert one(spark, files.file_type(F.lit(name))) == kind
    mb = 1024 * 1024
    rows = [("a.txt", "txt", int(4.5 * mb), b"x"), ("b.txt", "txt", int(4.6 * mb), b"x"), ("c.txt", "txt", 16 * mb, b"x"), ("d.epub", "epub", 2, b"PK"), ("e.epub", "epub", 9, b"no zip at"), ("f.pdf", "pdf", 4, b"%PDF")]
    got = {r.name: (r.reason, r.needs_blob) for r in files.validate_files(spark.createDataFrame(rows, "name string, file_type string, size long, content binary")).collect()}
    assert got["a.txt"] == (None, False) and got["b.txt"] == (None, True) and got["f.pdf"][0] is None
    assert "15MB" in got["c.txt"][0] and "EPUB" in got["d.epub"][0] and "EPUB" in got["e.epub"][0]


def _epub():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_STORED) as z:
        z.writestr("mimetype", "application/epub+zip")
        z.writestr("OEBPS/content.html", "<html><body><h1>Test Chapter</h1><p>Some text here.</p></body></html>")
    return b.getvalue()


def test_extraction(spark):
    rows = [("a.epub", "epub", bytearray(_epub())), ("b.epub", "epub", bytearray(b"PK\x03\x04junk")), ("c.md", "md", bytearray("# Ünï\r\ntext".encode()))]
    got = {r.name: r for r in files.extract_text(spark.createDataFrame(rows, "name string, file_type string, content binary")).collect()}
    assert got["a.epub"].text == "Test Chapter Some text here."
    assert got["b.epub"].text is None and got["b.epub"].error
    assert got["c.md"].text == "# Ünï\ntext"


@pytest.mark.parametrize("profile", ["rag", "plain", "book"])
def test_recursive_split_invariants(profile):
    p = chunking.PROFILES[profile]
    text = "\n\n".join(f"## Part {k}\n" + " ".join(f"word{j}." for j in range(k * 7 % 400)) for k in range(40))
    out = chunking.recursive_split(text, p)
    assert all(0 < len(x) <= p.size for x in out)
    at = 0
    flat = "".join(text.split())
    for x in out:  # in order, and made of the text
        piece = "".join(x.split())
        found = flat.find(piece, max(0, at - p.overlap - p.size))
        assert found >= 0
        at = found
    assert flat.endswith("".join(out[-1].split()))
    assert chunking.recursive_split("", p) == []


def test_chunk_windows(spark):
    df = spark.createDataFrame([(1, "x" * 1000), (2, "x" * 1001), (3, ""), (4, "x" * 2600)], "id long, text string")
    got = {r["id"]: r["count"] for r in chunking.chunk_fixed(df).groupBy("id").count().collect()}
    assert got == {1: 1, 2: 2, 4: 3}
    with pytest.raises(ValueError):
        chunking.chunk_fixed(df, 100, 100)


def test_embedding_helpers(spark):
    df = spark.createDataFrame([(1, "The sky is blue."), (2, "The sun is bright."), (3, None)], "id long, content string")
    rows = embedding.embed_chunks(df, embedding.hashing_embedder(16)).collect()
    assert [len(r.embedding) for r in rows] == [16] * 3
    assert one(spark, vector.cosine_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0
    assert one(spark, vector.cosine_similarity(F.array(F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0)))) == 0


def test_versions_truncate(spark):
    v = spark.createDataFrame([(1, "2024-01-01 10:00:00", "Created by Ada"), (1, "2024-01-01 11:00:00", "Updated by Ada")], "id long, t string, content string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    s = spark.createDataFrame([(9, 1, "2024-01-01 11:00:00")], "id long, document_id long, t string").withColumn("document_created_at", F.col("t").cast("timestamp_ntz"))
    cut = v.filter("content like 'Created%'").select("id", F.col("created_at").alias("ts"))
    left, marks, gone = history.truncate_versions(v, s, cut)
    assert [r.content for r in left.collect()] == ["Created by Ada"] and gone.count() == 1 and marks.count() == 0
    assert history.latest_version(v).first().content == "Updated by Ada"


def test_votes_last_wins(spark):
    schema = "chat_id long, message_id long, is_upvoted boolean, ts timestamp_ntz"
    import datetime as d

    at = d.datetime(2024, 1, 1)
    got = history.upsert_votes(spark.createDataFrame([(1, 2, True, at)], schema), spark.createDataFrame([(1, 2, False, at), (1, 3, True, at)], schema))
    assert sorted((r.message_id, r.is_upvoted) for r in got.collect()) == [(2, False), (3, True)]


def test_unknown_cursor_is_an_error(spark):
    chats = spark.createDataFrame([(1, 1, "2024-01-01")], "id long, user_id long, t string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    with pytest.raises(Exception, match="unknown chat"):
        history.chat_history_page(chats, 5, spark.createDataFrame([(1, 77)], "user_id long, chat_id long"), "ending_before").collect()
    with pytest.raises(ValueError):
        history.chat_history_page(chats, 5, None, "ending_before")


def test_approximate_search_recall(spark):
    from conftest import DATA

    from docfold.sources.fixtures import Tables

    t = Tables(spark, DATA)
    c, d, q = t.document_chunks(), t.knowledge_documents(), t.queries()
    exact = vector.similarity_search(q, c, d, 10).select("query_id", "chunk_id")
    found = vector.approx_search(q, c, d, vector.train_lists(c, 8), probes=7).select("query_id", "chunk_id")
    assert exact.join(found, ["query_id", "chunk_id"]).count() >= 0.9 * exact.count()


# Fixed values.
RAG = ["\n## ", "\n### ", "\n#### ", "\n\n", "\n", ". ", "! ", "? ", "; ", ":", ", ", " ", ""]


@pytest.mark.parametrize("sep", RAG[:-1])
def test_rag_chunks_end_at_each_separator(sep):
    """A text that has one kind of separator ends its chunks there, and the separator opens the next chunk."""
    words = ["x" * 1500, "y" * 1500, "z" * 1500]
    assert list(chunking.PROFILES["rag"].separators) == RAG
    got = chunking.recursive_split(sep.join(words), chunking.PROFILES["rag"])
    assert got == [words[0], *((sep + w).strip() for w in words[1:])]


def test_rag_chunks_prefer_coarse_separators():
    text = ". ".join(f"Sentence {k} about a thing; with a clause: and a phrase, so" for k in range(200))
    parts = chunking.recursive_split(text, chunking.PROFILES["rag"])
    assert all(len(p) <= 2400 for p in parts) and all(p.startswith((". ", "Sentence 0")) for p in parts)


def test_migration_keeps_votes_of_kept_ids(spark):
    m = spark.createDataFrame(
        [(1, 1, "user", "hi", 0), (2, 1, "assistant", '[{"type":"tool-call","toolCallId":"c"}]', 1), (3, 1, "tool", '[{"type":"tool-result","toolCallId":"c"}]', 1), (4, 1, "assistant", '[{"type":"text","text":"a"},{"type":"reasoning","reasoning":"undefined"}]', 1), (5, 1, "user", "bye", 2)],
        "id long, chat_id long, role string, content string, m int",
    ).withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=F.col("m")))
    votes = spark.createDataFrame([(1, 2, True), (1, 4, False)], "chat_id long, message_id long, is_upvoted boolean")
    rows, kept = migrate.migrate_messages(m, votes)
    got = {r.id: r.parts for r in rows.select("id", migrate.parts_json(F.col("parts")).alias("parts")).collect()}
    assert got == {1: '[{"text":"hi","type":"text"}]', 2: '[{"result":null,"toolCallId":"c","type":"tool-call"},{"text":"a","type":"text"}]', 5: '[{"text":"bye","type":"text"}]'}
    assert [r.message_id for r in kept.collect()] == [2]


def test_parts_keep_every_field(spark):
    """Arguments, results, images, files and nested shapes of any kind come through a migration."""
    call = {"type": "tool-call", "toolCallId": "c1", "toolName": "search", "args": {"q": "été", "n": [1, 2.5, None, {"deep": True}]}}
    other = {"type": "tool-call", "toolCallId": "c2", "toolName": "search", "args": {}}
    images = [{"type": "image", "image": "data:1"}, {"type": "image", "image": "data:2"}, {"type": "file", "file": {"name": "a.pdf", "size": 3}}]
    result = {"type": "tool-result", "toolCallId": "c1", "result": [{"id": 1}, "x"], "isError": False}
    stray = {"type": "tool-result", "toolCallId": "c9", "result": 5}
    said = [{"type": "text", "text": "a"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b", "content": "a"}, {"type": "text", "text": "c", "content": "a"}, {"type": "text", "text": "d", "content": None}, {"no": "type"}, "bare", 7]
    rows = [(1, "user", json.dumps([{"type": "text", "text": "look"}, images[0]])), (2, "assistant", json.dumps([call, other, *images])), (3, "tool", json.dumps([result, stray])), (4, "assistant", json.dumps([*said, images[0]])), (5, "user", "[not json"), (6, "user", None), (7, "user", "[]")]
    m = spark.createDataFrame([(i, 1, role, body, i) for i, role, body in rows], "id long, chat_id long, role string, content string, m int").withColumn("created_at", F.expr("timestamp_ntz'2024-01-01 00:00:00'") + F.make_dt_interval(mins=F.col("m")))
    out, _ = migrate.migrate_messages(m, spark.createDataFrame([], "chat_id long, message_id long, is_upvoted boolean"))
    got = {r.id: json.loads(r.parts) for r in out.select("id", migrate.parts_json(F.col("parts")).alias("parts")).collect()}
    assert got[1] == [{"type": "text", "text": "look"}, images[0]]
    assert got[2] == [{**call, "result": result["result"]}, other, *images, stray, said[0], said[2], said[4], said[5], "bare", 7]
    assert got[5] == [{"type": "text", "text": "[not json"}] and got[6] == [{"type": "text", "text": None}] and got[7] == []
    assert all(r.attachments == [] for r in out.select("attachments").collect())
    assert dict(out.dtypes)["parts"] == "array<variant>"


def test_stream_ingest(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Some words. " * 200)
    (src / "b.exe").write_bytes(b"x")
    (src / "c.epub").write_bytes(_epub())
    jobs.stream_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    chunks = spark.read.parquet(str(tmp_path / "out/chunks"))
    assert {r.id for r in chunks.collect()} == {"a.txt", "c.epub"}
    assert [r.name for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()] == ["b.exe"]


def test_batch_twins(spark):
    batch = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1, "user")], "event_id long, t string, user_id long, role string").withColumn("ts", F.col("t").cast("timestamp"))
    assert jobs.rolling_quota(batch).count() == 24
    assert jobs.dedupe_events(batch.union(batch)).count() == 1


def _streamed(spark, tmp_path, batches, job):
    """What ``job`` appends when each of the batches arrives in a trigger of its own."""
    schema = "event_id long, ts timestamp, user_id long, role string"
    for k, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, t string, user_id long, role string").withColumn("ts", F.col("t").cast("timestamp")).select("event_id", "ts", "user_id", "role")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = job(spark.readStream.schema(schema).option("maxFilesPerTrigger", "1").parquet(str(tmp_path / "in")))
        jobs.drain(stream, lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / f"out/b={n}")), str(tmp_path / "ck"))
    return spark.read.parquet(str(tmp_path / "out")).drop("b")


def test_late_rows_are_dropped(spark, tmp_path):
    batches = [
        [(1, "2024-01-01 00:10:00", 1, "user"), (2, "2024-01-03 00:00:00", 2, "user")],
        # User 1 again, in windows that the watermark has passed, and once more in time.
        [(3, "2024-01-01 00:20:00", 1, "user"), (4, "2024-01-02 23:30:00", 1, "user")],
        [(5, "2024-02-01 00:00:00", 3, "user")],
    ]
    got = {(r.user_id, str(r.window_start)): r.messages for r in _streamed(spark, tmp_path, batches, jobs.rolling_quota).collect()}
    assert got[1, "2024-01-01 00:00:00"] == 1 and got[1, "2024-01-02 23:00:00"] == 1
    assert {k[0] for k in got} == {1, 2} and sum(n for (u, _), n in got.items() if u == 1) == 24 + 24


def test_replays_and_late_events(spark, tmp_path):
    batches = [
        [(1, "2024-01-01 10:00:00", 1, "user"), (2, "2024-01-01 12:00:00", 1, "user")],
        [(2, "2024-01-01 12:00:00", 1, "user"), (3, "2024-01-01 12:10:00", 1, "user"), (4, "2024-01-01 09:00:00", 1, "user")],
    ]
    got = sorted(r.event_id for r in _streamed(spark, tmp_path, batches, jobs.dedupe_events).collect())
    assert got == [1, 2, 3]


# ---- splits, differences, sheets, metadata ----
@pytest.mark.parametrize(
    "text, size, overlap, separators, keep, pieces",
    [
        ("aaa bbb ccc ddd", 10, 3, (" ", ""), False, ["aaa bbb", "bbb ccc", "ccc ddd"]),
        ("aaa bbb ccc ddd", 10, 0, (" ", ""), False, ["aaa bbb", "ccc ddd"]),
        ("intro\n## one two\n## x", 10, 0, ("\n## ", "\n", " ", ""), True, ["intro", "## one", "two", "## x"]),
        ("abcdefgh", 3, 1, ("",), False, ["abc", "cde", "efg", "gh"]),
        ("one.\n\ntwo three", 8, 0, ("\n\n", " ", ""), False, ["one.", "two", "three"]),
        ("  \n ", 5, 0, ("\n", " ", ""), False, []),
    ],
)
def test_known_splits(text, size, overlap, separators, keep, pieces):
    assert chunking.recursive_split(text, chunking.Profile(size, overlap, separators, keep)) == pieces


def test_splits_by_tokens(spark):
    words = lambda t: len(t.split())
    df = spark.createDataFrame([(1, "a b c d e"), (2, None)], "id long, text string")
    got = [r.content for r in chunking.chunk_recursive(df, chunking.Profile(3, 1, (" ", ""), False), words).orderBy("chunk_index").collect()]
    assert got == ["a b", "b c", "c d", "d e"]
    assert [r.n for r in df.select(T.token_estimate("text", words).alias("n")).collect()] == [5, None]


def _lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_diffs_are_minimal():
    g = random.Random(3)
    for _ in range(300):
        a, b = ([g.choice("abcde") for _ in range(g.randint(0, 12))] for _ in range(2))
        d = migrate.minimal_diff(a, b)
        assert [x for o, x in d if o <= 0] == a and [x for o, x in d if o >= 0] == b
        assert sum(o == 0 for o, _ in d) == _lcs(a, b)
    assert migrate.minimal_diff(["a", "b"], ["a", "c"]) == [(0, "a"), (-1, "b"), (1, "c")]


def test_version_diff_rows(spark):
    v = spark.createDataFrame([(1, "2024-01-01", "One. Two. Three."), (1, "2024-01-02", "One. Three. Four."), (2, "2024-01-01", None)], "id long, t string, content string").withColumn("created_at", F.col("t").cast("timestamp_ntz"))
    got = [(r.position, r.op, r.sentence.strip()) for r in migrate.version_diff(v).orderBy("position").collect()]
    assert got == [(0, 0, "One."), (1, -1, "Two."), (2, -1, "Three."), (3, 1, "Three."), (4, 1, "Four.")] or got == [(0, 0, "One."), (1, -1, "Two."), (2, 0, "Three."), (3, 1, "Four.")]
    assert migrate.version_diff(v.filter("id = 2")).count() == 0


@pytest.mark.parametrize(
    "text, fixed",
    [
        ("D a t a S c i e n c e is fun", "data science is fun"), ("h e l l o world", "hello world"), ("T h e n e w m o d e l", "the new model"), ("fooBar end.Next", "foo Bar end. Next"), ("a b", "b"),
        ("no change here", "no change here"), ("", ""), (None, ""), ("x y z1", "y z1"),
    ],
)
def test_spaced_letters(spark, text, fixed):
    assert one(spark, T.repair_spaced_letters(F.lit(text).cast("string"))) == fixed


def test_sheet_rows(spark):
    wide = ",".join(["", *[""] * 27, "far"])
    text = f'a,"b, b"\n , \n"two\nlines",c\n\n{wide}\n'
    df = spark.createDataFrame([(1, text), (2, None)], "id long, content string")
    got = files.clean_sheet_rows(df).collect()
    assert [(r.row_no, r.A, r.B, len(r.cells)) for r in got] == [(1, "a", "b, b", 2), (2, "two\nlines", "c", 2), (3, "", "", 29)]
    assert got[2].cells[28] == "far" and got[0].C is None
    padded = files.clean_sheet_rows(df, 5).collect()
    assert sorted((r.id, r.row_no) for r in padded) == [(i, k) for i in (1, 2) for k in range(1, 6)]
    assert {r.Z for r in padded} == {""} and {r.A for r in padded if r.id == 2} == {""}


def test_nested_metadata(spark):
    df = spark.sql("select named_struct('a', ' x\\u0007 y ', 'n', 3, 'm', map(' k\\u0001 ', array('p  q', null))) as m, '{\"a \":[{\"b\":\" x\\\\u0007  y \",\"n\":1.5,\"t\":null}]}' as j")
    r = df.select(T.sanitize_nested("m", df.schema["m"].dataType).alias("m"), T.sanitize_json("j").alias("j"), T.sanitize_json(F.lit("{broken")).alias("bad")).first()
    assert (r.m.a, r.m.n, r.m.m) == ("x y", 3, {"k": ["p q", None]})
    assert r.j == '{"a":[{"b":"x y","n":1.5,"t":null}]}' and r.bad is None
    assert one(spark, T.sanitize_metadata(F.create_map(F.lit(" a\x01"), F.lit(None).cast("string")))) == {"a": ""}


@pytest.mark.parametrize(
    "query, profile, threshold",
    [("two words", "strict", 0.3), ("one two three four five six seven eight", "strict", 0.4), ("one two three four", "strict", 0.35), ("two words", "debug", 0.15), ("what one two three four five six seven eight", "debug", 0.32), ('one "two"', "debug", 0.15)],
)
def test_other_threshold_profiles(spark, query, profile, threshold):
    assert one(spark, T.dynamic_threshold(F.lit(query), 0.35, profile)) == pytest.approx(threshold)


def test_strict_labels(spark):
    got = [one(spark, T.relevance_label(F.lit(x), "strict")) for x in (0.8, 0.7, 0.5, 0.3, 0.29)]
    assert got == ["Highly Relevant", "Very Relevant", "Relevant", "Somewhat Relevant", "Low Relevance"]


def test_book_sections(spark):
    schema = "query_id long, rank int, result_id string, chunk_id long, document_id long, chunk_index int, content string, title string, similarity double, keyword_boost double, file_type string, chapter_title string, chapter_order int"
    rows = [(1, 1, "a", 1, 1, 4, "x", "t", 0.9, None, "epub", "Storms", 2), (1, 2, "b", 2, 1, 5, "x", "t", 0.8, None, "epub", None, 3), (1, 3, "c", 3, 2, 6, "x", "t", 0.7, None, "pdf", "Storms", 2), (1, 4, "d", 4, 1, 7, "x", "t", 0.6, None, "epub", "Storms", None)]
    got = [r.section for r in rerank.format_results(spark.createDataFrame(rows, schema)).orderBy("rank").collect()]
    assert got == ["Chapter: Storms", "Chapter: Chapter 4", "Chunk 7", "Chunk 8"]


def test_short_summaries_of_long_blanks(spark):
    for text in ("  " * 5000 + "word " * 10, ("ab" + " " * 400) * 200, "x" * 149, "x" * 150, "x" * 151, " " + "y" * 150 + " \n", "z" * 151 + " more", "", "\u3000 \n"):
        whole = " ".join(text.split())
        cut = whole[:151].rpartition(" ")[0]
        want = whole if len(whole) <= 150 else (cut or whole[:150]) + "..."
        assert one(spark, T.summarize(F.lit(text))) == want


def test_search_runs_once(spark):
    from conftest import DATA

    from docfold.plans.registry import QUERIES

    df = QUERIES["v13_search_pipeline"](spark, DATA)
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("FlatMapCoGroupsInPandas") == 1


def test_helpers_see_bounded_batches(spark):
    """Chunks and extracted files come through Arrow batches of few rows, whatever the session had."""
    docs = spark.range(400).select(F.col("id").cast("string").alias("id"), F.lit("some words").alias("text"))
    sent = docs.select(F.col("id").alias("name"), F.lit("txt").alias("file_type"), F.col("text").cast("binary").alias("content"))
    for job in (lambda: chunking.chunk_recursive(docs), lambda: files.extract_text(sent)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        assert job().count() == 400
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 128
