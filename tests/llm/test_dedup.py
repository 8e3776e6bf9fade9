"""Exact, near and substring deduplication against brute force, and their edge cases."""

import collections
import hashlib
import random
import re

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from docfold.llm import queries
from docfold.llm.exact_dedup import drop_exact_duplicates, exact_dedup
from docfold.llm.graph import connected_components
from docfold.llm.minhash import across_components, drop_near_duplicates, near_duplicates, shingle_sets, sketches
from docfold.llm.suffix_dedup import drop_repeats, remove_repeats, repeated_suffixes

DOC = "doc_id long, text string, lang string, h string, keep_id string"


def frame(spark, rows):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "x", "y") for i, t in rows], DOC)


ODD = [(1, "same"), (2, "same"), (2, "same"), (3, ""), (4, None), (5, "other"), (None, "other"), (None, None), (6, "é" * 3000)]


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_odd_rows(spark, keep):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup(frame(spark, ODD), keep=keep).collect()), key=repr)
    best = min if keep == "min" else max
    groups = collections.defaultdict(list)
    for i, t in ODD:
        groups[t or ""].append(i)
    want = []
    for ids in groups.values():
        known = [i for i in ids if i is not None]
        k = best(known) if known else None
        want += [(i, k, len(ids), i == k) for i in ids]
    assert got == sorted(want, key=repr)


def test_exact_collisions_are_told_apart(spark):
    rows = [(1, "aa"), (2, "bb"), (3, "aa"), (4, "ccc"), (5, "bb")]
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(frame(spark, rows), hash_fn=lambda c: F.length(c).cast("string")).collect()}
    assert got == {1: (1, 2), 3: (1, 2), 2: (2, 2), 5: (2, 2), 4: (4, 1)}


def test_exact_empty_and_drop(spark):
    assert exact_dedup(frame(spark, [])).count() == 0
    out = drop_exact_duplicates(frame(spark, ODD))
    assert out.columns == frame(spark, []).columns
    assert sorted((r.doc_id, r.text) for r in out.collect() if r.doc_id) == [(1, "same"), (3, ""), (5, "other"), (6, "é" * 3000)]


def test_exact_query(spark, same):
    same(queries.op7_exact_dedup(spark, DATA), queries.ORACLES["op7_exact_dedup"])


WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def shingles(text, n=5):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def brute_components(rows, percent):
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("percent, block", [(85, 64), (80, 2), (85, 5)])
def test_near_against_brute_force(spark, percent, block):
    g = random.Random(3)
    base = [g.choice("abcdefghij") * g.randint(1, 3) + str(g.randint(0, 60)) for _ in range(120)]
    rows = [(0, " ".join(base))]
    for i in range(1, 120):  # chains of edits: some pairs link only by others
        w = list(rows[g.randrange(len(rows))][1].split(" "))
        for _ in range(g.choice([0, 0, 1, 2, 4])):
            w[g.randrange(len(w))] = f"new{g.randint(0, 999)}"
        rows.append((i, " ".join(w)))
    rows += [(200, ""), (201, "  \n"), (202, "one two"), (203, "ONE two"), (204, "x " * 5000)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(spark, rows), percent=percent, block=block).collect()}
    assert got == brute_components(rows, percent)


def test_near_odd_rows(spark):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(frame(spark, [(1, "a b"), (1, "a b"), (2, "A b"), (None, "a b"), (3, None)])).collect()), key=repr)
    assert got == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 1, None, True), (3, 0, 3, True)], key=repr)
    assert near_duplicates(frame(spark, [])).count() == 0
    assert sorted(r.doc_id for r in drop_near_duplicates(frame(spark, [(1, "a b"), (2, "a b"), (3, None)])).collect()) == [1, 3]


def test_near_copies_below_the_threshold_stay_linear(spark):
    """2,000 copies of one text whose similarities lie around 0.8: no link, and no list of their pairs."""
    g = random.Random(9)
    base = [f"w{k}" for k in range(250)]
    rows = []
    for i in range(2000):
        w = list(base)
        for at in g.sample(range(0, 250, 5), 6):
            w[at] = f"e{i}x{at}"
        rows.append((i, " ".join(w)))
    rows.append((5000, rows[7][1] + " more"))  # a copy of one of them
    got = {r.doc_id: r.component_id for r in near_duplicates(frame(spark, rows), percent=85).collect()}
    assert got == {i: i for i in range(2000)} | {5000: 7}


def test_compare_gives_a_forest(spark):
    import numpy as np

    g = np.random.default_rng(4)
    base = np.unique(g.integers(1, 1 << 62, 300, dtype=np.uint64))
    nodes = []
    for i in range(300):  # 200 strangers that all link with each other, 100 that link with none
        own = g.integers(1, 1 << 62, 12 if i < 200 else 60, dtype=np.uint64)
        nodes.append((b"%016d" % i, np.sort(np.concatenate([base[len(own) :], own]))))
    full = spark.createDataFrame([(n, s.tobytes()) for n, s in nodes], "node binary, shingles binary")
    open_ = spark.createDataFrame([(1, n, n, len(s)) for n, s in nodes], "key long, node binary, component binary, n_shingles int")
    for block in (1024, 50):
        edges = [(bytes(r.a), bytes(r.b)) for r in across_components(open_, full, 85, block).collect()]
        parts = -(-299 // block)
        assert 199 <= len(edges) <= 300 * parts
        assert {x for e in edges for x in e} == {n for n, _ in nodes[:200]}
        joined = {bytes(r.component) for r in connected_components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
        assert len(joined) == 1


def test_near_ids_with_several_texts(spark):
    """An id with two texts is one document, which links what either text is like."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(5, a), (5, b), (5, b), (2, a + " end"), (9, b + " end"), (1, c), (7, c)]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == [(1, 1, True), (2, 2, True), (5, 2, False), (5, 2, False), (5, 2, False), (7, 1, False), (9, 2, False)]


def test_near_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op5_minhash(spark, DATA).collect()}
    assert got == brute_components(rows, 85)


def test_sketch_estimates_similarity():
    import numpy as np

    g = np.random.default_rng(1)
    for n, share in ((3, 1.0), (60, 0.5), (5000, 0.8)):
        both = int(2 * n * share / (1 + share))
        a = g.integers(1, 1 << 62, n, dtype=np.uint64)
        b = np.concatenate([a[:both], g.integers(1, 1 << 62, n - both, dtype=np.uint64)])
        s = sketches(np.concatenate([a, b]), np.repeat([0, 1], n), 2)
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        assert abs((s[0] == s[1]).mean() - both / (2 * n - both)) < 0.2


def test_shingles_of_rows():
    import numpy as np

    text = b"a b c d e f" + b"" + b"A B c D E f"
    sh, row = shingle_sets(np.frombuffer(text, np.uint8), np.array([0, 11, 11, 22]), 5)
    assert row.tolist() == [0, 0, 2, 2] and sh[:2].tolist() == sh[2:].tolist()


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 4), (10, 9), (9, 8), (5, 5), (1, 2)] + [(100 + k, 101 + k) for k in range(40)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 8: 8, 9: 8, 10: 8} | {100 + k: 100 for k in range(41)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        spans = sum(1 for k in range(len(b)) if gone[k] and (not k or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def removed(df):
    return {r.doc_id: (r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in df.collect()}


def passages():
    g = random.Random(5)
    text = lambda n: "".join(g.choice("abc dé") for _ in range(n))
    shared = [text(n) for n in (99, 100, 101, 140, 400)]
    rows = [(i, text(g.randint(0, 300)) + g.choice(shared) + text(g.randint(0, 90)) + g.choice(shared)) for i in range(60)]
    rows += [(100, "a" * 700), (101, "ab" * 300), (102, ""), (103, None), (104, rows[3][1]), (105, "x" * 99), (106, shared[4] * 3)]
    return rows


@pytest.mark.parametrize("asked, hot", [(16, 1000), (1, 2), (2, 1)])
def test_repeats_against_brute_force(spark, asked, hot):
    rows = passages()
    assert removed(remove_repeats(frame(spark, rows), block_bytes=4000, asked_runs=asked, hot_runs=hot)) == brute_repeats(rows)


@pytest.mark.parametrize("bits, hot", [(0, 1000), (2, 1000), (5, 3)])
def test_repeats_with_colliding_hashes(spark, bits, hot):
    """With hashes of so few bits that most runs collide, within blocks and between them, bytes still decide."""
    rows = passages()
    assert removed(remove_repeats(frame(spark, rows), block_bytes=4000, hot_runs=hot, hash_bits=bits)) == brute_repeats(rows)


def test_repeats_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op3_suffix_dedup(spark, DATA).collect()}
    assert got == brute_repeats(rows)


def test_repeats_odd_rows(spark):
    t = "0123456789" * 12
    rows = [(1, t), (1, t), (None, t), (2, None)]
    got = sorted(((r.doc_id, r.n_bytes, len(r.spans)) for r in remove_repeats(frame(spark, rows)).collect()), key=repr)
    # In the first text every window from the tenth byte on repeats an earlier one; the others are repeats as a whole.
    assert got == sorted([(None, 120, 1), (1, 120, 1), (1, 120, 1), (2, 0, 0)], key=repr)
    assert remove_repeats(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        remove_repeats(frame(spark, rows), length=20)
    out = drop_repeats(frame(spark, [(1, "é" * 80), (2, "x" + "é" * 80)]))
    assert out.columns == frame(spark, []).columns
    assert {r.doc_id: r.text for r in out.collect()}[2].startswith("x") and out.filter("lang = 'en' and h = 'x'").count() == 2


def test_tables_are_dropped(spark):
    rows = near_duplicates(frame(spark, ODD)).collect()
    assert rows
    from docfold.llm.common import drop_tables, materialize

    df = materialize(spark.range(3))
    assert df.count() == 3
    drop_tables(spark)
    with pytest.raises(Exception):
        df.count()


def test_rows_that_share_an_id_are_spread(spark):
    """Null and repeated ids don't gather in one block, and the result is that of the rows in the order given to them."""
    from docfold.llm.blocks import with_blocks

    rows = [(None, f"{k} " * 60) for k in range(300)] + [(7, f"x{k} " * 60) for k in range(300)]
    blocks, n, _ = with_blocks(frame(spark, rows), "doc_id", "text", 4000, 1 << 20)
    most = max(r["count"] for r in blocks.groupBy("block").count().collect())
    assert n > 20 and most < 100
    got = remove_repeats(frame(spark, rows + [(9, rows[5][1]), (9, rows[400][1])]), block_bytes=4000).collect()
    assert len(got) == 602 and all(len(r.kept) == 0 for r in got if r.doc_id == 9)


def test_rows_that_repeat_whole_are_spread(spark):
    """Equal rows take several blocks, each evaluation the same, and all of them but the first lose their text."""
    from docfold.llm.blocks import with_blocks

    text = "".join(f"{k * k * 7919 % 1009} " for k in range(60))
    df = frame(spark, [(5, text)] * 5000 + [(None, None)] * 500)
    blocks, n, _ = with_blocks(df, "doc_id", "text", 40_000, 1 << 20)
    sizes = {r.block: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert n > 20 and max(sizes.values()) < 3 * 5500 / n
    assert {r.block: r["count"] for r in blocks.repartition(3).groupBy("block").count().collect()} == sizes
    got = remove_repeats(df, block_bytes=40_000).collect()
    assert len(got) == 5500 and sum(len(r.kept) > 0 for r in got) == 1


def test_written_tables_keep_their_tasks(spark, monkeypatch):
    """The join that carries and compares texts runs in as many tasks as there are shuffle partitions."""
    from docfold.llm import exact_dedup as module
    from docfold.llm.common import materialize

    files = []
    monkeypatch.setattr(module, "materialize", lambda df: files.append(len((out := materialize(df)).inputFiles())) or out)
    held = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        assert exact_dedup(frame(spark, [(k, f"text {k % 900}") for k in range(2000)])).filter("kept").count() == 900
        assert files == [24, 24]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_suffix_sort_verifies_bytes(monkeypatch):
    """With hashes that all collide, bytes still decide."""
    import numpy as np

    from docfold.llm import suffix_dedup

    data = np.frombuffer(b"aaaabbbbaaaa", np.uint8)
    monkeypatch.setattr(suffix_dedup, "prefix_hashes", lambda d: np.zeros(len(d) + 1, np.uint64))
    got = repeated_suffixes(data, np.array([0, 4, 8]), np.zeros(3, int), np.arange(3), 4)
    assert got.tolist() == [False, False, True]
