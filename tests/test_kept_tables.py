"""Tables kept up by merges: versions, replays, growth, pruned reads; and the statistics and votes on them."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from docfold.operators import stats
from docfold.sources.buckets import BucketTable
from docfold.streaming import jobs

ROWS = "k long, v string"
CHUNKS = "id long, document_id long, content string, created_at timestamp_ntz"


def put(held, changes):
    return held.join(changes.select("k"), "k", "left_anti").unionByName(changes)


def rows(table):
    return {r.k: r.v for r in table.read().collect()}


def folders(path):
    return {f.parent for f in path.rglob("*.parquet")}


def test_merges_versions_and_growth(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), ROWS, "k", bucket_rows=50)
    assert rows(t) == {} and t.current() is None
    want = {}
    for n in range(6):
        fresh = {k: f"{n}" for k in (range(100) if n == 0 else random.Random(n).sample(range(300), 5))}
        want |= fresh
        assert t.merge(spark.createDataFrame(list(fresh.items()), ROWS), put)
        assert rows(t) == want
    v = t.current()
    assert v.buckets >= 2 and sum(v.rows.values()) == len(want) and len(t.versions()) == 2
    # What the last two versions don't name is gone.
    assert len(folders(tmp_path / "t/data")) <= len(v.written) + len(t.current(t.versions()[0]).written)


def test_a_merge_replaces_only_its_folders(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), ROWS, "k", bucket_rows=10)
    t.merge(spark.createDataFrame([(k, "a") for k in range(200)], ROWS), put)
    t.merge(spark.createDataFrame([(1, "b")], ROWS), put)  # grows
    before = t.current()
    t.merge(spark.createDataFrame([(3, "c")], ROWS), put)
    after = t.current()
    assert before.buckets == after.buckets >= 16 and sum(before.written[b] != after.written[b] for b in after.written) == 1
    read = t.read_keys(spark.createDataFrame([(3, "")], ROWS).select("k"))
    assert [r.v for r in read.collect()] == ["c"] and len(read.inputFiles()) == 1


def test_a_merge_that_empties_a_folder(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), ROWS, "k")
    t.merge(spark.createDataFrame([(1, "a")], ROWS), put)
    t.merge(spark.createDataFrame([(1, "")], ROWS), lambda held, changes: held.limit(0))
    assert rows(t) == {} and t.current().written == {}
    t.merge(spark.createDataFrame([(2, "b")], ROWS), put)
    assert rows(t) == {2: "b"}


VOTE = jobs.VOTES


def vote_rows(spark, rows):
    return spark.createDataFrame([(c, m, up, datetime.datetime(2024, 1, 1, h)) for c, m, up, h in rows], VOTE)


@pytest.mark.parametrize("fails_at", ["write", "publish", "after"])
def test_votes_survive_a_lost_driver(spark, tmp_path, monkeypatch, fails_at):
    """A batch that stops before, while or after it is published, and runs again, keeps all votes."""
    table = jobs.vote_table(spark, str(tmp_path / "votes"))
    run = lambda: jobs.stream_votes(spark.readStream.schema(VOTE).parquet(str(tmp_path / "in")), table, str(tmp_path / "ck")).awaitTermination()
    vote_rows(spark, [(c, 1, True, 0) for c in range(40)]).write.parquet(str(tmp_path / "in"))
    run()
    vote_rows(spark, [(3, 1, False, 1), (3, 2, True, 1)]).write.mode("append").parquet(str(tmp_path / "in"))
    own = BucketTable.publish

    def lost(self, v):
        if fails_at == "after":
            own(self, v)
        elif fails_at == "write":
            # Half of what the batch wrote is there, and a draft.
            (tmp_path / "votes/data/version=1/bucket=0/part-junk.parquet").write_bytes(b"PAR1")
        raise RuntimeError("the driver is lost")

    monkeypatch.setattr(BucketTable, "publish", lost)
    with pytest.raises(Exception, match="lost"):
        run()
    before = {(c, 1): True for c in range(40)}
    after = before | {(3, 1): False, (3, 2): True}
    read = lambda: {(r.chat_id, r.message_id): r.is_upvoted for r in table.read().collect()}
    assert read() == (after if fails_at == "after" else before)
    monkeypatch.setattr(BucketTable, "publish", own)
    run()
    assert read() == after and table.read().count() == len(after)
    assert table.merge(vote_rows(spark, [(3, 1, True, 5)]), lambda held, new: new, number=1) is False and read() == after


def test_sums_follow_many_changes(spark, tmp_path):
    """After every batch of changes the sums are those of the whole table."""
    rng = random.Random(4)
    chunks, sums = BucketTable(spark, str(tmp_path / "c"), CHUNKS, "document_id", 40), BucketTable(spark, str(tmp_path / "s"), stats.SUMS, "document_id", 10)
    alive, n = {}, 0
    for step in range(5):
        fresh = []
        for _ in range(60 if step == 0 else 15):
            fresh.append((n, rng.randrange(25), "x" * rng.randrange(9), datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=rng.randrange(300))))
            n += 1
        gone = rng.sample(sorted(alive), min(len(alive), 20))
        if step == 4:  # a whole document leaves
            gone = sorted(set(gone) | {i for i, r in alive.items() if r[1] == 7})
            fresh = [r for r in fresh if r[1] != 7]
        added, removed = spark.createDataFrame(fresh, CHUNKS), spark.createDataFrame([alive.pop(i) for i in gone], CHUNKS)
        alive |= {r[0]: r for r in fresh}
        stats.change_chunks(chunks, added, removed)
        stats.refresh_sums(sums, added, removed, chunks)
        whole = spark.createDataFrame(list(alive.values()), CHUNKS)
        assert sorted(map(tuple, chunks.read().select("id").collect())) == sorted((i,) for i in alive)
        assert sorted(map(tuple, sums.read().collect())) == sorted(map(tuple, stats.chunk_sums(whole).collect()))


def test_sums_read_no_chunk_that_need_not_be(spark, tmp_path, monkeypatch):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    base = [(d * 10 + k, d, "abc", at(10 * k)) for d in range(30) for k in range(4)]
    chunks, sums = BucketTable(spark, str(tmp_path / "c"), CHUNKS, "document_id", 8), BucketTable(spark, str(tmp_path / "s"), stats.SUMS, "document_id", 8)
    none = spark.createDataFrame([], CHUNKS)
    first = spark.createDataFrame(base, CHUNKS)
    for t, how in ((chunks, lambda: stats.change_chunks(chunks, first, none)), (sums, lambda: stats.refresh_sums(sums, first, none, chunks))):
        how()
    stats.change_chunks(chunks, spark.createDataFrame([(999, 2, "abcd", at(15))], CHUNKS), none)  # grows to more folders
    asked = []
    own = BucketTable.read_keys
    monkeypatch.setattr(BucketTable, "read_keys", lambda self, keys: asked.append(out := own(self, keys)) or out)
    # Neither an insert nor a chunk from the middle takes a date away.
    stats.refresh_sums(sums, spark.createDataFrame([(999, 2, "abcd", at(15))], CHUNKS), spark.createDataFrame([base[1], base[6]], CHUNKS), chunks)
    assert asked == []
    stats.change_chunks(chunks, none, spark.createDataFrame([base[1], base[6], base[4]], CHUNKS))
    stats.refresh_sums(sums, none, spark.createDataFrame([base[4]], CHUNKS), chunks)
    (read,) = asked
    opened = [f for f in read.inputFiles() if "/c/data/" in f]
    assert {r.document_id for r in read.collect()} == {1} and len(opened) == 1 < len(chunks.read().inputFiles())
    held = {r.document_id: r for r in sums.read().collect()}
    assert held[1].first_chunk_date == at(10) and held[1].chunk_count == 2 and held[0].first_chunk_date == at(0) and held[2].chars == 16


def test_each_file_is_extracted_once(spark, tmp_path, monkeypatch):
    """Both outputs of an ingest come from one extraction."""
    from docfold.sources import files

    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("Some words. " * 200)
    (src / "b.exe").write_text("no")
    (src / "c.md").write_text(" \n")
    seen = spark.sparkContext.accumulator(0)
    own = files.extract_text

    def counted(df):
        def count(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return own(df.mapInArrow(count, df.schema))

    monkeypatch.setattr(files, "extract_text", counted)
    jobs.stream_ingest(spark, str(src), str(tmp_path / "out"), str(tmp_path / "ck"), settle=0).awaitTermination()
    assert seen.value == 2
    assert {r.id for r in spark.read.parquet(str(tmp_path / "out/chunks")).collect()} == {"a.txt"}
    assert {(r.name, r.reason) for r in spark.read.parquet(str(tmp_path / "out/rejects")).collect()} == {("b.exe", "Unsupported file type"), ("c.md", "No text content found")}
