"""Line dedup, cross-tokenizer alignment and embedding whitening against brute force."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from conftest import DATA

from docfold.llm import queries
from docfold.llm.alignment import Aligner, Vocabulary, align, align_documents, byte_level, pieces
from docfold.llm.line_dedup import line_dedup
from docfold.llm.whitening import Planes, fit_whitening, whitened_components

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# ---- line dedup ----
def plain_lines(rows, least=10):
    holders = defaultdict(set)
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)})
    for i, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= least:
                holders[key(line)].add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        gone = [n for n, x in enumerate(lines) if len(holders.get(key(x), ())) > 1 and i != min((h for h in holders[key(x)] if h is not None))]
        out.append((i, len(lines), gone, "\n".join(x for n, x in enumerate(lines) if n not in gone)))
    return sorted(out, key=repr)


LINES = [
    (1, "A shared line here\nown\n\n"), (2, "  a SHARED line here\t\nnext one of its own\nA shared line here"), (3, None), (4, ""), (5, "\n\nshort 123\n"), (6, "short 123\nÄÖÜäöüßéèà\nlast"), (7, "äöüäöüßéèà\nÄÖÜäöüßéèà"),
    (8, "twice in here\ntwice in here"), (9, "x" * 20_000 + "\nTwice in here"), (9, "another row of nine\nshared by nine and null"), (9, "another row of nine\nshared by nine and null"),
    (None, "shared by nine and null\nonly null holds this"), (None, "only null holds this\nstays here too"), (10, "\n".join(f"line number {k} of many" for k in range(300))), (11, "\n".join(f"LINE number {k} of many" for k in range(0, 300, 2))),
]


def test_lines_like_brute_force(spark):
    df = spark.createDataFrame(LINES, "doc_id long, text string").selectExpr("*", "1 as row", "2 as key", "3 as pos", "4 as keeper", "5 as dropped", "6 as lines")
    got = sorted(((r.doc_id, r.n_lines, r.dropped, r.kept) for r in line_dedup(df).collect()), key=repr)
    assert got == plain_lines(LINES)


def test_lines_of_other_tables(spark):
    assert line_dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [(k, f"the same line {'!' * (k % 2)}") for k in range(9)]
    got = line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=5).collect()
    assert sorted(r.doc_id for r in got if r.dropped) == [2, 4, 6, 8]


# ---- alignment ----
def plain_alignment(rows):
    """Whole texts by the libraries, ends as lists, and all pairs of a group."""
    import sentencepiece
    from tokenizers import Tokenizer
    from tokenizers.decoders import ByteLevel

    t, model = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    assert ByteLevel().decode([t.id_to_token(262)]) == " the"
    _, body, _ = byte_level(A)
    docs, counts = [], Counter()
    for i, text in rows:
        found = None
        if text:
            ids = t.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
            names = [model.id_to_piece(x) for x in ids[1]]
            held = [body[x] for x in ids[0]], [bytes.fromhex(n[3:5]) if model.is_byte(x) else n.replace("▁", " ").encode() for x, n in zip(ids[1], names)]
            if all(b"".join(h) == (" " + text).encode() for h in held):
                ends = [np.cumsum([len(x) for x in h]).tolist() for h in held]
                groups, links, i0, j0 = [], [], 0, 0
                for e in sorted(set(ends[0]) & set(ends[1])):
                    i1, j1 = sum(x <= e for x in ends[0]), sum(x <= e for x in ends[1])
                    groups.append(",".join(map(str, ids[0][i0:i1])) + "|" + ",".join(map(str, ids[1][j0:j1])))
                    links += [(ids[0][x], ids[1][y]) for x in range(i0, i1) for y in range(j0, j1) if ends[0][x] == ends[1][y]]
                    i0, j0 = i1, j1
                found = (len(ids[0]), len(ids[1]), groups, links)
                counts.update(links)
        docs.append((i, found))
    top = defaultdict(int)
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for i, f in docs:
        n_a, n_b, groups, links = f or (0, 0, [], [])
        out.append((i, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[1]] for x in links), sum(counts[x] for x in links), ";".join(groups)))
    return sorted(out, key=repr)


TEXTS = [
    (1, "a  b\n c\t d <|endoftext|> x"), (2, " lead"), (3, "trail  "), (4, ""), (5, None), (6, "▁ a raw mark"), (7, "café — naïve x y 　 z"), (8, "\n\n \n  word\r\n"), (9, "日本語 の テキスト 😀😀 x"),
    (10, "a\x00b \x1f c \x85 d   e"), (11, "it's  we'll '  's"), (11, "it's  we'll '  's"), (None, "<s> </s> <unk> <0x0A> word"), (12, "x" * 5000 + " " * 300 + "y"), (13, "é ́ ​ ﻿ z "), (14, " "), (15, "_ a _ b ! c"), (16, "\n"), (17, "the cat the hat"),
]


@pytest.mark.parametrize("block_bytes", [1, 1 << 20])
def test_alignment_like_brute_force(spark, block_bytes):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string").selectExpr("*", "1 as block", "2 as pair", "3 as groups", "4 as count")
    got = align_documents(df, A, B, block_bytes=block_bytes).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_alignment(TEXTS)


def test_alignment_of_no_rows(spark):
    assert align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_alignment_remembers_little():
    """What was forgotten, and texts that can't be aligned, change no other text."""
    few, many = (Aligner(byte_level(A), pieces(B), remember=n) for n in (3, 10_000))
    texts = [t for _, t in TEXTS]
    for k in range(len(texts)):
        x = few.texts(texts[k : k + 1])
        y = many.texts(texts[k : k + 1])
        assert [[few.known[c][:4] for c in each] for each in x] == [[many.known[c][:4] for c in each] for each in y]


def test_tokens_without_bytes_end_together():
    words = Vocabulary([b"", b"a", b"b", b""], [b""] * 7 + [b"ab", b""])
    got = align([1, 2, 3], [7, 8], b"ab", words)
    assert got.text == "1,2,3|7,8;" and got.linked.tolist() == [4]
    assert sorted(got.links.tolist()) == sorted(x << 32 | y for x in (2, 3) for y in (7, 8))
    assert align([1, 2], [7], b"abc", words) is None


def test_long_runs_and_long_words():
    few = Aligner(byte_level(A), pieces(B))
    rows = [(1, "a" + " " * 3000 + "b"), (2, "\n" * 2500), (3, "ab" * 1500 + " x"), (4, "é" * 2000)]
    for (i, text), want in zip(rows, [plain_alignment([r])[0] for r in rows]):
        (each,) = few.texts([text])
        assert ";".join(few.known[c][3] for c in each) == want[7]
    (each,) = few.texts(["a" + " " * 300_000 + "b"])
    assert len(each) == 2 and all(few.known[c][2] for c in each)


def test_alignment_query_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_alignment(spark, DATA).collect()]
    want = [(*r[:7], hashlib.sha256(r[7].encode()).hexdigest() if r[7] else "") for r in plain_alignment(rows)]
    assert sorted(got, key=repr) == sorted(want, key=repr)


# ---- whitening ----
def plain_whitening(vectors, k=8):
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * r[j] - s[j] for j in range(d)] for r in x]
    v = np.array([[float(sum(r[i] * r[j] for r in z)) / n**3 for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    u = u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])
    return n, [sum(a * a for a in r) for r in z], (np.array(z, float) / n) @ u / np.sqrt(e), e / np.trace(v)


def test_bit_slices_are_exact():
    rng = np.random.default_rng(3)
    for spread in (1, 2, 1 << 11, 1 << 40):
        x = rng.integers(-spread, spread, (777, 5))
        x[:, 2] = 7
        planes = Planes.of(x.min(0), x.max(0))
        s, t = planes.scatter(planes.pack(x), len(x))
        y = (x - x.min(0)).astype(object)
        assert (s == y.sum(0)).all()
        assert (np.triu(t) == np.triu(y.T @ y)).all()


def test_whitening_query_like_brute_force(spark):
    e = pd.read_parquet(f"{DATA}/embeddings.parquet")
    e = e[[v is not None and np.isfinite(np.asarray(v, float)).all() for v in e.embedding]]
    n, deviation, whitened, explained = plain_whitening(list(e.embedding))
    got = queries.op11_whitening(spark, DATA).toPandas()
    assert len(got) == 8 * len(e) and set(got.n) == {n}
    assert got[got.component == 1].set_index("vec_id").deviation.to_dict() == dict(zip(e.vec_id, deviation))
    np.testing.assert_allclose(got.pivot(index="vec_id", columns="component", values="whitened").loc[e.vec_id].to_numpy(), whitened, atol=1e-9)
    np.testing.assert_allclose(got.groupby("component").explained.first().to_numpy(), explained, rtol=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(50, 4)) * [5, 3, 2, 1]
    rows = [(k, v.tolist()) for k, v in enumerate(good)] + [(None, good[0].tolist()), (0, good[0].tolist())]
    odd = [(90, None), (91, []), (92, [1.0, None, 2.0, 3.0]), (93, [1.0, math.inf, 2.0, 3.0]), (94, [1.0, 2.0, 3.0]), (95, [math.nan] * 4)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as v", "2 as n", "3 as id", "4 as component")
    got = whitened_components(df).toPandas()
    n, deviation, whitened, explained = plain_whitening([v for _, v in rows])
    assert len(got) == 4 * len(rows) and set(got.n) == {n}
    order = lambda t: sorted(t, key=repr)
    want = [(i, c + 1, round(float(whitened[r, c]), 6) + 0.0) for r, (i, _) in enumerate(rows) for c in range(4)]
    assert order((None if pd.isna(i) else int(i), int(c), round(w, 6) + 0.0) for i, c, w in zip(got.vec_id, got.component, got.whitened)) == order(want)
    assert sorted(int(x) for x in got[got.component == 1].deviation) == sorted(deviation)


def test_whitening_without_variance(spark):
    assert whitened_components(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []
    assert fit_whitening(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")) is None
    got = whitened_components(spark.createDataFrame([(1, [0.5, 0.25])] * 3, "vec_id long, embedding array<float>")).collect()
    assert len(got) == 6 and {(r.whitened, r.explained, r.identity_error, int(r.deviation)) for r in got} == {(0.0, 0.0, 0.0, 0)}
    flat = whitened_components(spark.createDataFrame([(k, [float(k), 1.0]) for k in range(5)], "vec_id long, embedding array<double>")).toPandas()
    assert flat[flat.component == 2].whitened.abs().max() == 0 and flat.identity_error.max() < 1e-9 and flat[flat.component == 1].explained.iloc[0] == 1


def test_whitening_of_huge_entries(spark):
    """Whole numbers that leave 64 bits when multiplied stay exact."""
    rows = [(k, [1e12 * (k % 7) + k, 3.0 * k]) for k in range(20)]
    got = whitened_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).toPandas()
    n, deviation, whitened, _ = plain_whitening([v for _, v in rows])
    assert [int(x) for x in got[got.component == 1].sort_values("vec_id").deviation] == deviation
