"""Equal texts go to the model once, in one run and over runs; differences in linear memory."""

import random
import tracemalloc

import numpy as np
import pytest

from docfold.operators import embedding, migrate


def counting(spark, fail_on=None):
    seen = spark.sparkContext.accumulator(0)

    def embed(texts):
        if fail_on in texts:
            raise ValueError("the model is gone")
        seen.add(len(texts))
        return embedding.letter_embedder(texts)

    return embed, seen


def test_texts_are_embedded_once(spark, tmp_path):
    cache = embedding.embedding_cache(spark, str(tmp_path / "cache"), bucket_rows=20)
    texts = [f"text number {k % 30}" for k in range(200)] + [None, "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, content string").repartition(7)
    embed, seen = counting(spark)
    got = {r.id: r.embedding for r in embedding.embed_cached(df, embed, cache).collect()}
    assert seen.value == 31 and len(got) == 203
    want = dict(enumerate(embedding.letter_embedder([t or "" for t in texts])))
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)
    more = spark.createDataFrame([(k, t) for k, t in enumerate(texts[:40] + ["fresh", "fresh"])], "id long, content string")
    assert embedding.embed_cached(more, embed, cache).count() == 42 and seen.value == 32
    assert embedding.embed_cached(df, embed, cache).count() == 203 and seen.value == 32
    assert cache.read().count() == 32 and not list(tmp_path.glob("cache/fresh-*"))


def test_a_lost_run_leaves_the_cache(spark, tmp_path):
    cache = embedding.embedding_cache(spark, str(tmp_path / "cache"))
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, content string")
    embed, seen = counting(spark, fail_on="b")
    with pytest.raises(Exception, match="gone"):
        embedding.embed_cached(df, embed, cache)
    assert cache.current() is None
    embed, seen = counting(spark)
    assert embedding.embed_cached(df, embed, cache).filter("embedding is not null").count() == 2 and seen.value == 2


def test_no_rows(spark, tmp_path):
    cache = embedding.embedding_cache(spark, str(tmp_path / "cache"))
    embed, seen = counting(spark)
    got = embedding.embed_cached(spark.createDataFrame([], "id long, content string"), embed, cache)
    assert got.columns == ["id", "content", "embedding"] and got.count() == 0 and seen.value == 0


def length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_divided_differences_are_as_short(monkeypatch):
    rng = random.Random(6)
    for cells in (1, 30, 200):
        monkeypatch.setattr(migrate, "TABLE_CELLS", cells)
        for _ in range(60):
            a, b = ([rng.choice("abcd" + "xyz"[: rng.randrange(4)]) for _ in range(rng.randrange(30))] for _ in range(2))
            got = migrate.minimal_diff(a, b)
            assert [s for o, s in got if o <= 0] == a and [s for o, s in got if o >= 0] == b
            assert sum(o == 0 for o, _ in got) == length(a, b)
            assert all(not (p == 1 and q == -1) for (p, _), (q, _) in zip(got, got[1:]))


def test_a_long_difference_takes_little_memory():
    """20,000 sentences, with new ones throughout and a block that was moved: a table would have 400 million cells."""
    rng = random.Random(7)
    a = [f"s{k}" for k in range(20_000)]
    b = [s for k, s in enumerate(a) if k % 100]
    for k in range(200):
        b.insert(rng.randrange(len(b)), f"new{k}")
    b = [*b[9000:], *b[:9000]]
    tracemalloc.start()
    got = migrate.minimal_diff(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150_000_000
    assert [s for o, s in got if o <= 0] == a and [s for o, s in got if o >= 0] == b
    assert sum(o == 0 for o, _ in got) >= 10_000
