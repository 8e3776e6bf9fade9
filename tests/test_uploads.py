"""The uploads data source: batches, archive entries, and streams over files that arrive between runs."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from docfold.sources import files, uploads
from docfold.streaming import jobs


def book(**entries):
    with io.BytesIO() as f:
        with zipfile.ZipFile(f, "w") as z:
            for name, body in entries.items():
                z.writestr(name, body)
        return f.getvalue()


@pytest.fixture
def folder(tmp_path):
    src = tmp_path / "in"
    (src / "deep").mkdir(parents=True)
    (src / "a.txt").write_bytes("Ünicode".encode())
    (src / "empty.md").write_bytes(b"")
    (src / "deep" / "b.epub").write_bytes(book(mimetype="m", one="1" * 300, two=""))
    (src / "deep" / "broken.epub").write_bytes(b"PK\x03\x04 no archive")
    (src / "_hidden").write_bytes(b"x")
    (src / ".part").write_bytes(b"x")
    return src


def test_every_file_is_a_row(spark, folder):
    got = {r.name: r for r in files.read_files(spark, str(folder)).collect()}
    assert set(got) == {"a.txt", "empty.md", "b.epub", "broken.epub"}
    assert got["a.txt"].content.decode() == "Ünicode" and got["a.txt"].size == 8
    assert got["empty.md"].content == b"" and got["empty.md"].size == 0 and got["empty.md"].file_type == "md"
    one = files.read_files(spark, str(folder / "a.txt")).collect()
    assert [r.name for r in one] == ["a.txt"]
    assert {r.name: r.content for r in files.read_files(spark, f"file://{folder}", max_bytes=8).collect()} == {"a.txt": "Ünicode".encode(), "empty.md": b"", "b.epub": None, "broken.epub": None}
    assert "content" not in files.read_files(spark, str(folder), content=False).columns


def test_an_empty_folder_and_a_missing_one(spark, tmp_path):
    assert files.read_files(spark, str(tmp_path)).collect() == []
    with pytest.raises(Exception, match="nowhere"):
        files.read_files(spark, str(tmp_path / "nowhere")).collect()
    with pytest.raises(Exception, match="need a path"):
        spark.read.format("uploads").load().collect()


def test_tasks_read_bounded_bytes(spark, tmp_path):
    for k in range(20):
        (tmp_path / f"f{k}.txt").write_bytes(b"x" * 10_000)
    (tmp_path / "long.txt").write_bytes(b"x" * 100_000)
    uploads.register(spark)
    df = spark.read.format("uploads").option("partitionBytes", 50_000).load(str(tmp_path))
    per = df.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).collect()
    assert sum(r.n for r in per) == 21 and len(per) >= 7
    assert all(r.bytes <= 50_000 or r.n == 1 for r in per)


def test_entries(spark, folder):
    got = {(r.name, r.entry): r for r in files.read_entries(spark, str(folder)).collect()}
    assert set(got) == {("a.txt", None), ("empty.md", None), ("b.epub", "mimetype"), ("b.epub", "one"), ("b.epub", "two"), ("broken.epub", None)}
    assert got["b.epub", "one"].content == b"1" * 300 and got["b.epub", "one"].entry_no == 1 and got["b.epub", "two"].content == b""
    assert got["broken.epub", None].content is None and "BadZipFile" in got["broken.epub", None].error
    assert got["a.txt", None].error is None


def test_a_damaged_entry_leaves_the_others(spark, tmp_path):
    body = bytearray(book(one="a" * 50, two="b" * 50))
    body[body.index(b"a" * 50) + 3] ^= 1
    (tmp_path / "x.epub").write_bytes(body)
    got = {r.entry: r for r in files.read_entries(spark, str(tmp_path)).collect()}
    assert got["one"].content is None and "BadZipFile" in got["one"].error and got["two"].content == b"b" * 50


def drained(spark, folder, checkpoint):
    uploads.register(spark)
    got = []
    df = spark.readStream.format("uploads").option("settle", 0).load(str(folder)).select("name", "size")
    jobs.drain(df, lambda batch, n: got.extend(r.name for r in batch.collect()), str(checkpoint))
    return sorted(got)


def test_stream_takes_each_file_once(spark, tmp_path):
    src = tmp_path / "in"
    assert drained(spark, src, tmp_path / "ck") == []
    src.mkdir()
    (src / "a").write_bytes(b"1"), (src / "b").write_bytes(b"")
    assert drained(spark, src, tmp_path / "ck") == ["a", "b"]
    assert drained(spark, src, tmp_path / "ck") == []
    (src / "c").write_bytes(b"3")
    assert drained(spark, src, tmp_path / "ck") == ["c"]
    # The latest file goes: what is left isn't read again, and what comes later is.
    os.remove(src / "c")
    assert drained(spark, src, tmp_path / "ck") == []
    (src / "d").write_bytes(b"4")
    assert drained(spark, src, tmp_path / "ck") == ["d"]


def test_offsets_span_times_and_wait(tmp_path):
    for k, name in enumerate("abcd"):
        (tmp_path / name).write_bytes(b"x")
        os.utime(tmp_path / name, ns=(k, 1_000 + k))
    (tmp_path / "new").write_bytes(b"x")
    stream = uploads.UploadStream({"path": str(tmp_path), "settle": "3600"})
    assert stream.initialOffset() == {"taken": -1} and stream.latestOffset() == {"taken": 1_003}
    names = [f[1][-1] for p in stream.partitions({"taken": 1_000}, {"taken": 1_002}) for f in p.files]
    assert names == ["b", "c"]
    assert stream.partitions({"taken": 1_003}, {"taken": 1_001}) == []


def test_ingest_refuses_empty_and_oversized_uploads(spark, folder, tmp_path):
    (folder / "huge.txt").write_bytes(b"x" * (15 * files.MB + 1))
    jobs.stream_ingest(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "ck"), settle=0).awaitTermination()
    bad = {r.name: r.reason for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()}
    assert bad.pop("broken.epub").startswith("BadZipFile")
    assert bad.pop("b.epub", None) in (None, "No text content found")
    assert bad == {"empty.md": "No text content found", "huge.txt": "File size exceeds 15MB limit"}
    assert "a.txt" in {r.id for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()}
