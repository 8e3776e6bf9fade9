"""Classifiers, language models, tokenisation, packing and search."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
from conftest import DATA
from pyspark import Broadcast
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from docfold.llm import katz, langid, packing, quality, queries, toxicity
from docfold.llm.byte_bpe import decode_documents, encode_documents, load_ranks
from docfold.llm.pretokens import pieces
from docfold.llm.vector_search import ApproximationFile, exact_top_k, smallest_of_each

DOC = "doc_id long, text string, lang string, score double, label int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, 0.5, 7) for i, t, *rest in rows for lang in [rest[0] if rest else None]], DOC)


ODD = [(1, ""), (2, None), (3, "plain words here"), (3, "plain words here"), (None, "plain words here"), (4, "word " * 40_000), (5, "  \n\t"), (6, "日本語 😀 é")]


# ---- classifiers ----
@pytest.fixture(scope="module")
def labelled(spark):
    g = random.Random(2)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    rows, marks = [], []
    for i in range(400):
        w = [g.choice(words) for _ in range(g.randint(20, 60))]
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            w[g.randrange(len(w))] = g.choice(["vilestuff", "vilething", "vilewords"])
        t = " ".join(w)
        rows.append((i, t.upper().replace(" ", "!! ") if junk else t.capitalize() + "."))
        marks.append((i, int(not junk), int(bad)))
    return frame(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def accuracy(scores, labels, column, at):
    j = scores.join(labels, "doc_id").select((F.col("score") >= at).cast("int").alias("p"), F.col(column).alias("y")).collect()
    return sum(r.p == r.y for r in j) / len(j)


def test_quality(spark, labelled):
    docs, labels = labelled
    train = labels.filter("doc_id % 3 <> 0")
    model = quality.train_quality(docs, train)
    assert accuracy(quality.score_quality(docs, model), labels.filter("doc_id % 3 = 0"), "quality", 0.3) > 0.97
    odd = quality.score_quality(frame(spark, ODD), model).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert {r.score for r in odd if r.doc_id in (1, 2)} == {0.0}
    assert quality.score_quality(frame(spark, []), model).count() == 0
    none = quality.train_quality(docs, train.limit(0))
    assert {r.score for r in quality.score_quality(docs.limit(3), none).collect()} == {0.5}


def test_quality_is_a_plain_neighbour_vote(spark, labelled):
    """Scores equal a vote that takes one document and one labelled vector at a time."""
    docs, labels = labelled
    model = quality.train_quality(docs, labels.filter("doc_id % 3 <> 0"), dims=12)
    some = docs.filter("doc_id % 40 = 0").collect()
    got = {r.doc_id: r.score for r in quality.score_quality(docs.filter("doc_id % 40 = 0"), model).collect()}
    for r in some:
        body = r.text.encode()
        terms = quality.quality_terms(np.frombuffer(body, np.uint8), np.array([0, len(body)]))[0]
        mine = [float(sum((terms - model.mean) * axis)) for axis in model.axes.T]
        cos = []
        for other in model.vectors.tolist():
            dot = sum(a * b for a, b in zip(mine, other))
            cos.append(dot / math.sqrt(sum(a * a for a in mine)) / math.sqrt(sum(b * b for b in other)))
        near = sorted(range(len(cos)), key=lambda k: -cos[k])[: model.neighbours]
        weight = [max(cos[k], 0) ** 8 * model.votes[k] for k in near]
        assert got[r.doc_id] == pytest.approx(sum(w * model.labels[k] for w, k in zip(weight, near)) / sum(weight), abs=1e-3)


def test_quality_can_learn_words(spark):
    """Two classes whose texts differ in nothing but two words of one shape."""
    g = random.Random(8)
    rows = []
    for i in range(300):
        w = [g.choice(["some", "more", "text", "with", "word", "here"]) for _ in range(30)]
        for at in g.sample(range(30), 8):
            w[at] = ("fine", "junk")[i % 2]
        rows.append((i, " ".join(w)))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(300)], "doc_id long, quality int")
    docs = frame(spark, rows)
    model = quality.train_quality(docs, labels.filter("doc_id < 200"))
    assert accuracy(quality.score_quality(docs, model), labels.filter("doc_id >= 200"), "quality", 0.5) > 0.95


def test_toxicity_training_is_one_plan_at_every_size_and_frees_the_driver(spark, monkeypatch):
    """Labels, which grow with the texts, are not broadcast; nets don't reach the driver all at once and don't stay there."""
    rows = [(i, f"word{i % 7} other{i % 3} {'awful' if i % 4 == 0 else 'fine'} {i}", "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(80)], "doc_id long, toxic int")
    plans, gone, shared = [], [], []
    kept, send, destroy = toxicity.materialize, spark.sparkContext.broadcast, Broadcast.destroy
    monkeypatch.setattr(toxicity, "materialize", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or kept(df))
    monkeypatch.setattr(spark.sparkContext, "broadcast", lambda x: shared.append(send(x)) or shared[-1])
    monkeypatch.setattr(Broadcast, "destroy", lambda b, blocking=False: gone.append(id(b)) or destroy(b, blocking))
    frame, collected = type(docs), []
    collect = frame.collect
    monkeypatch.setattr(frame, "collect", lambda df: collected.extend(df.columns) or collect(df))
    toxicity.train_toxicity(docs, labels, buckets=1 << 10, dim=8, filters=4)
    assert len(plans) == 1 and "SortMergeJoin" in plans[0] and "BroadcastHashJoin" not in plans[0]
    assert len(shared) == 3 and sorted(gone) == sorted(map(id, shared))
    assert "change" not in collected and "cell" in collected


def test_toxicity(spark, labelled):
    docs, labels = labelled
    train = labels.filter("doc_id % 3 <> 0")
    net = toxicity.train_toxicity(docs, train)
    assert accuracy(toxicity.score_toxicity(docs, net), labels.filter("doc_id % 3 = 0"), "toxic", 0.5) > 0.9
    odd = toxicity.score_toxicity(frame(spark, ODD), net).collect()
    assert len(odd) == len(ODD) and all(0 <= r.score <= 1 for r in odd)
    assert all(r.score < 0.5 for r in odd if r.doc_id in (1, 2, 5))
    kept = toxicity.drop_toxic(docs.unionByName(frame(spark, ODD)), net)
    assert kept.columns == docs.columns
    toxic = labels.filter("toxic = 1").select("doc_id")
    assert kept.join(toxic, "doc_id").filter("doc_id > 6").count() < 0.3 * toxic.count()
    assert toxicity.drop_toxic(frame(spark, []), net).count() == 0


def test_each_language_is_calibrated(spark):
    g = random.Random(3)
    words = {x: [f"{x}{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"] for x in ("aa", "bb")}
    rows, marks = [], []
    for i in range(2600):
        lang, bad = ("bb" if i % 20 < 3 else "aa"), i % 10 == 0
        w = [g.choice(words[lang]) for _ in range(g.randint(5, 15))]
        if bad or g.random() < (0.4 if lang == "bb" else 0.02):
            w[g.randrange(len(w))] = "vilestuff"
        rows.append((i, " ".join(w), lang))
        marks.append((i, int(bad)))
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    # 40 toxic rows in bb: a quarter of them is too few for a threshold, and a small sample holds too few.
    labels = labels.join(docs.select("doc_id", "lang"), "doc_id").filter("lang = 'aa' or toxic = 0 or doc_id < 800").drop("lang")
    assert labels.join(docs, "doc_id").filter("lang = 'bb' and toxic = 1").count() == 40
    for bounds in ({}, {"n_toxic": 60, "n_clean": 120}):
        net = toxicity.train_toxicity(docs, labels, buckets=1 << 12, dim=8, filters=4, epochs=2, **bounds)
        own = dict(zip(net.langs, net.thresholds))
        assert set(own) == {"aa", "bb"} and own["bb"] != net.thresholds[-1]
        assert net.calibration_rows["bb"][0] == 40 and net.calibration_rows["bb"][1] >= 200


def test_every_labelled_row_is_learned_from(spark):
    """Far more rows than one block has: thresholds count all, and words of any of them are known."""
    g = random.Random(5)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    # A toxic row has one of sixty words, and each of those is in few rows.
    rows = [(i, " ".join([g.choice(words) for _ in range(8)] + ([f"{i // 8 % 60:02d}vile"] if i % 8 == 0 else [])), "aa") for i in range(2600)]
    docs, labels = frame(spark, rows), spark.createDataFrame([(i, int(i % 8 == 0)) for i, *_ in rows], "doc_id long, toxic int")
    for bounds in ({}, {"n_toxic": 50, "n_clean": 100}):
        net = toxicity.train_toxicity(docs, labels, buckets=1 << 12, dim=8, **bounds)
        assert net.calibration_rows == {"aa": (325, 2275)}
        assert accuracy(toxicity.score_toxicity(docs, net), labels.filter("toxic = 1"), "toxic", 0.5) > 0.95
        assert accuracy(toxicity.score_toxicity(docs, net), labels, "toxic", 0.5) > 0.97


def test_words_of_rows_in_a_file():
    """Rows beyond the bound are kept in a file, in order, empty ones too."""
    g = np.random.default_rng(2)
    rows = [g.integers(0, 99, (n, 3)).astype(np.int32) for n in (3, 0, 5, 1)]
    for most in (0, 40, 1000):
        held = toxicity.Words(most)
        for x in rows:
            held.add(x, np.array([len(x)]))
        assert len(held) == 4 and all(np.array_equal(a, b) for a, b in zip(held, rows))
        assert np.array_equal(held.of(np.array([2, 0]))[0], rows[2])


def test_long_texts_are_learned_from(spark):
    """Toxic rows that are all far longer than other texts train the net and are found; a bound in bytes holds."""
    g = random.Random(11)
    words = [f"{a}{b}{c}" for a in "bcdf" for b in "aeiou" for c in "lmnr"]
    rows, marks = [], []
    for i in range(160):
        w = [g.choice(words) for _ in range(4000 if i % 4 == 0 else g.randint(20, 60))]
        if i % 4 == 0:
            for at in g.sample(range(4000), 40):
                w[at] = f"vile{at % 30}"
        rows.append((i, " ".join(w), "aa"))
        marks.append((i, int(i % 4 == 0)))
    assert min(len(t) for i, t, _ in rows if i % 4 == 0) > 12_000
    rows += [(1000 + i, " ".join(g.choice(words) for _ in range(4000)), "aa") for i in range(40)]
    marks += [(1000 + i, 0) for i in range(40)]
    docs, labels = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    net = toxicity.train_toxicity(docs, labels, buckets=1 << 12)
    assert net.calibration_rows["aa"] == (40, 160)
    assert accuracy(toxicity.score_toxicity(docs, net), labels, "toxic", 0.5) > 0.95
    few = toxicity.train_toxicity(docs, labels, buckets=1 << 12, max_train_bytes=200_000, epochs=1)
    assert len(toxicity.score_toxicity(docs, few).collect()) == 200


def plain_pooled(net, words):
    """Best response of each filter over one row's words, one window at a time."""
    out = []
    for w in toxicity.WIDTHS:
        windows = [sum(net.emb[words[at + j]].sum(0) @ net.kernels[w, j] for j in range(w) if at + j < len(words)) for at in range(len(words))]
        out.append(np.max(windows, axis=0))
    return np.concatenate(out)


def test_convolution_is_the_plain_one():
    net, g = toxicity.Net(64, 4, 3, 1), np.random.default_rng(0)
    for n in (1, 2, 3, 17):
        ids = g.integers(0, 64, (n, 3)).astype(np.int32)
        want = plain_pooled(net, ids)
        for tables in (None, net.tables()):
            assert np.allclose(net.pooled(ids, np.array([n]), tables)[0][0], want, atol=1e-5)


def test_gradients_of_the_net():
    """One step of ``fit`` moves every parameter against the numeric gradient of the loss."""
    g = np.random.default_rng(5)
    ids = [g.integers(0, 16, (n, 3)).astype(np.int32) for n in (3, 5, 2, 7)]
    y = np.array([1, 0, 0, 1], np.float32)
    net = toxicity.Net(16, 3, 2, 4)
    for name in ("emb", "out", "bias"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    net.kernels = {k: v.astype(np.float64) for k, v in net.kernels.items()}
    net.bias += 0.3  # away from the corners of max(x, 0)

    def loss():
        logit = np.array([np.maximum(plain_pooled(net, x) + net.bias, 0) @ net.out + net.out_bias for x in ids])
        return float(np.mean(np.log1p(np.exp(np.where(y == 1, -logit, logit))))) + 0.5e-4 * float(net.out @ net.out)

    names = [net.emb, net.out, net.bias, *net.kernels.values()]
    numeric = []
    for x in names:
        d = np.zeros_like(x)
        for at in np.ndindex(x.shape):
            x[at] += 1e-5
            up = loss()
            x[at] -= 2e-5
            d[at] = (up - loss()) / 2e-5
            x[at] += 1e-5
        numeric.append(d)
    before = [x.copy() for x in names]
    net.fit(ids, y, 1, 1e-3, 0, most_steps=1)
    for x, start, d in zip([net.emb, net.out, net.bias, *net.kernels.values()], before, numeric):
        # Adagrad's first step from moments of 1e-3.
        assert np.allclose(start - x, 1e-3 * d / np.sqrt(1e-3 + d * d), atol=2e-7)


def test_convolution_sees_no_other_row():
    net = toxicity.Net(64, 4, 3, 1)
    g = np.random.default_rng(0)
    ids = g.integers(0, 64, (9, 3)).astype(np.int32)
    together, _ = net.pooled(ids, np.array([4, 0, 5]), net.tables())
    apart = [net.pooled(ids[:4], np.array([4]), net.tables())[0], net.pooled(ids[4:], np.array([5]), net.tables())[0]]
    assert np.allclose(together[[0, 2]], np.concatenate(apart), atol=1e-5) and (together[1] == 0).all()


def test_classifier_queries(spark):
    for name, column, at in (("op1_quality", "quality", 0.3), ("op2_toxicity", "toxic", 0.5)):
        got = queries.QUERIES[name](spark, DATA).collect()
        assert len(got) == spark.read.parquet(f"{DATA}/documents.parquet").count()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= at) for r in got)


def test_language(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    train = docs.filter("doc_id % 3 <> 0")
    models = langid.train_langid(train)
    held = langid.identify_language(docs.filter("doc_id % 3 = 0"), models).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in held) > 0.95 * len(held)
    odd = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify_language(frame(spark, [*ODD, (7, "123 !!")]), models).collect()}
    assert {(1, "und", 0.0), (2, "und", 0.0), (5, "und", 0.0), (7, "und", 0.0)} <= odd
    assert langid.identify_language(frame(spark, []), models).count() == 0
    strange = langid.identify_language(frame(spark, [(1, "日本語の文章です"), (2, docs.first().text)]), models).collect()
    assert {r.doc_id: r.rejected for r in strange} == {1: True, 2: False}


def test_language_with_nothing_to_learn(spark, tmp_path):
    """An empty table gives no rows; without any known language every text is ``und``."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for rows in (docs.limit(0), docs.withColumn("lang", F.lit(None).cast("string")), docs.withColumn("text", F.lit(None).cast("string"))):
        models = langid.train_langid(rows)
        got = langid.identify_language(rows, models).collect()
        assert models.langs == [] and len(got) == rows.count()
        assert {(r.lang_pred, r.score, r.rejected) for r in got} <= {("und", 0.0, False)}
    docs.limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert queries.op6_langid(spark, str(tmp_path)).collect() == []
    docs.withColumn("lang", F.lit(None).cast("string")).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    assert {r.lang_pred for r in queries.op6_langid(spark, str(tmp_path)).collect()} == {"und"}


def test_seventy_languages(spark):
    """Every language that occurs can be predicted, the rarest too."""
    g = random.Random(12)
    alphabets = {f"l{k:02}": [chr(0x4E00 + 40 * k + j) for j in range(30)] for k in range(70)}
    rows = [(1000 * k + i, "".join(g.choice(alphabets[x]) for _ in range(60)), x) for k, x in enumerate(alphabets) for i in range(2 + k % 5)]
    models = langid.train_langid(frame(spark, rows))
    assert len(models.langs) == 70
    fresh = [(k, "".join(g.choice(alphabets[x]) for _ in range(40)), x) for k, x in enumerate(alphabets)]
    got = {r.doc_id: r.lang_pred for r in langid.identify_language(frame(spark, fresh), models).collect()}
    assert got == {k: x for k, _, x in fresh}


def plain_kneser_ney(texts, d=langid.DISCOUNT):
    """Interpolated Kneser-Ney over characters from the formulas, with dictionaries."""
    tri = collections.Counter(t[k : k + 3] for t in ("  " + x.lower() for x in texts) for k in range(len(t) - 2))
    bi = collections.Counter(t[1:] for t in tri)
    uni = collections.Counter(t[1:] for t in bi)
    letters = {c for t in tri for c in t}

    def p(context, c):
        if not context:
            total = sum(uni.values())
            return max(uni[c] - d, 0) / total + d * len(uni) / total / (len(letters) + 1)
        counts = tri if len(context) == 2 else bi
        own = {x: n for x, n in counts.items() if x[:-1] == context}
        if not own:
            return p(context[1:], c)
        total = sum(own.values())
        return max(own.get(context + c, 0) - d, 0) / total + d * len(own) / total * p(context[1:], c)

    return lambda text: -sum(math.log10(p(t[k : k + 2], t[k + 2])) for t in ["  " + text.lower()] for k in range(len(text))) / len(text)


def test_language_models_are_kneser_ney():
    teach = {"a": ["abracadabra", "banana band", "a cab"], "b": ["oh no", "moon photo", "boot on"]}
    counts = [dict(collections.Counter(langid.grams(*langid.characters(t))[0].tolist())) for t in teach.values()]
    alone = langid.LanguageModels(["a"], counts[:1])
    for text in ("abra", "Band cab", "banana", "nab a"):
        assert alone.cross_entropy([text])[0, 0] == pytest.approx(plain_kneser_ney(teach["a"])(text), rel=1e-4)


def test_language_query(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = queries.op6_langid(spark, DATA).collect()
    assert len(got) == len(docs) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in held) > 0.95 * len(held)


def test_language_models_are_normalised():
    m = langid.LanguageModels(["a"], [dict(collections.Counter(langid.grams(*langid.characters(["abracadabra", "banana band"]))[0].tolist()))])
    letters = sorted({int(k) for k in m.keys[1]})
    for context in ("ab", "an", "zz"):
        keys = np.array([(ord(context[0]) << 42) | (ord(context[1]) << 21) | c for c in [*letters, ord("~")]], np.uint64)
        assert m._lookup(3, keys)[:, 0].sum() == pytest.approx(1)


# ---- tokens ----
PIECES = regex.compile(public_tokenizers.PATTERN)


def test_pieces_follow_the_pattern():
    g = random.Random(4)
    parts = ["a", "s", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "'", "'s", "1", "²", "ä", "!", "$$", " ", "中", "́", "_", "😀", "\r\n", "\x1c"]
    for _ in range(3000):
        texts = ["".join(g.choice(parts) for _ in range(g.randint(0, 9))) for _ in range(3)]
        got, counts = pieces(texts)
        assert got == [p for t in texts for p in PIECES.findall(t)] and counts.tolist() == [len(PIECES.findall(t)) for t in texts]


def test_byte_bpe(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={})
    rows = [*ODD, (7, "<|endoftext|> don't DON'T  we'll")]
    out = decode_documents(encode_documents(frame(spark, rows), ranks, public_tokenizers.PATTERN, block_bytes=300), ranks).collect()
    want = sorted(((i, bpe.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids), bytes(r.decoded)) for r in out), key=repr) == want
    assert encode_documents(frame(spark, []), ranks, public_tokenizers.PATTERN).count() == 0


def test_byte_bpe_of_rows_in_changing_order(spark, monkeypatch):
    """Rows that come in another order each time they are evaluated are written once, then encoded as any others."""
    from docfold.llm import byte_bpe, common

    written = []
    monkeypatch.setattr(common, "materialize", lambda df, own=common.materialize: written.append(df) or own(df))
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    encode = lambda df: {r.doc_id: r.ids for r in encode_documents(df, ranks, public_tokenizers.PATTERN, block_bytes=3000).collect()}
    want = encode(docs)
    assert not written
    assert encode(docs.orderBy(F.rand())) == want and len(written) == 1
    assert encode(docs.repartition(7)) == want and len(written) == 2
    assert encode(docs.unionByName(docs.filter("doc_id < 0"))) == want and len(written) == 2
    assert byte_bpe.repeatable(docs.filter(F.rand() < 0.5)).count() < docs.count() and len(written) == 3


def test_byte_bpe_query(spark):
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(ranks), special_tokens={})
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op4_byte_bpe(spark, DATA).collect()}
    for r in spark.read.parquet(f"{DATA}/documents.parquet").collect():
        ids = bpe.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r.text.encode()).hexdigest())


def brute_cuts(places, costs, rule):
    exact = {1 << b for b in range(12) if rule.size // 128 < 1 << b < rule.size}
    best = {0: 0}
    for i in range(1, len(places)):
        best[i] = min(best[j] + (0 if places[i] - places[j] in exact else rule.size - (places[i] - places[j])) for j in range(i) if places[i] - places[j] <= rule.size) + costs[i] + rule.window_cost
    return best[len(places) - 1]


def test_cuts_are_the_cheapest():
    g = random.Random(9)
    rule = packing.PackingRule(size=128, plain_step=8)
    for _ in range(40):
        ends = np.cumsum([g.randint(1, 90) for _ in range(g.randint(1, 12))])
        sentences = np.array(sorted({g.randint(1, int(ends[-1])) for _ in range(10)}))
        places, costs = packing.cut_places(ends, sentences, rule)
        cuts = [0, *packing.choose_cuts(places, costs, rule)]
        cost = dict(zip(places.tolist(), costs.tolist()))
        exact = {1 << b for b in range(12) if rule.size // 128 < 1 << b < rule.size}
        paid = sum((0 if b - a in exact else rule.size - (b - a)) + cost[b] + rule.window_cost for a, b in zip(cuts, cuts[1:]))
        assert cuts[-1] == ends[-1] and paid == brute_cuts(places.tolist(), costs.tolist(), rule)


def test_packing(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(file)
    rows = [r for r in ODD if r[0] is not None and r[0] != 3] + [(k, f"Sentence {k}. " * k) for k in range(10, 60)]
    out = packing.pack_documents(frame(spark, rows), file).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for i, t, *_ in rows:
        ids = np.array([*tk.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(ids[at : at + r.length].tobytes()))
            at += r.length
        assert at == len(ids)
    for rs in by_seq.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    odd = packing.pack_documents(frame(spark, [(None, "a"), (1, None), (1, None)]), file)
    assert odd.count() == 3 and packing.pack_documents(frame(spark, []), file).count() == 0


def test_packing_query(spark):
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out, sequences = collections.defaultdict(list), collections.Counter()
    for r in queries.op9_packing(spark, DATA).collect():
        out[r.doc_id].append(r)
        sequences[r.sequence_id] += r.length
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    assert set(out) == {r.doc_id for r in docs} and max(sequences.values()) <= 1024
    for d in docs:
        ids = np.array([*tk.encode(d.text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(out[d.doc_id], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) and [r.start for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        assert all((r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in own)


def test_packing_matches_added_tokens(spark):
    file = public_tokenizers.path("byte_bpe_50k.json")
    tk = Tokenizer.from_file(file)
    end = "<|endoftext|>"
    texts = [f"a{end}b", end, f"{end}{end} x", f"One. Two!{end}Three.  {end}\n don't", f"<|endoftext{end}|> <|ENDOFTEXT|>", f"it{end}'s", f"'{end}s x{end}", "plain. text", "", f"Sentence. {end} " * 900]
    out = collections.defaultdict(list)
    for r in packing.pack_documents(frame(spark, list(enumerate(texts))), file).collect():
        out[r.doc_id].append(r)
    encoder = packing.piece_encoder(file)
    for i, (t, (_, closes)) in enumerate(zip(texts, packing.encode_step(texts, encoder, 0))):
        ids = np.array([*tk.encode(t, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(out[i], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids)
        assert all((r.doc_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids[r.start : r.start + r.length].tobytes())) for r in own)
        # Positions of sentence ends count added tokens too.
        assert all(tk.decode([int(ids[c - 1])])[-1] in ".!?\n" for c in closes)
    assert 50256 in tk.encode(texts[0]).ids


# ---- search ----
def test_top_k_against_sql(spark, same):
    same(queries.op8_exact_topk(spark, DATA), queries.ORACLES["op8_exact_topk"])


def test_top_k_odd_rows(spark):
    nan = float("nan")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.5, 0.5]), (4, None), (5, [nan, 1.0]), (6, [None, 1.0]), (7, [1.0]), (8, []), (None, [1.0, 1.0]), (9, [-1.0, float("inf")]), (1, [1.0, 0.0])]
    v = spark.createDataFrame([(i, x, "a") for i, x in rows], "vec_id long, embedding array<float>, score string")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in exact_top_k(v, v.filter("vec_id = 0"), 3, block_rows=2).orderBy("rank").collect()]
    one = 1024 * 1024
    assert got == [(0, 1, 1, one), (0, 2, 2, one), (0, 3, 3, one // 2)]
    assert exact_top_k(v.limit(0), v.limit(0), 3).count() == 0


def test_bounds_hold_and_stop_early():
    g = np.random.default_rng(8)
    v = g.integers(-1000, 1000, (3000, 16)).astype(float)
    q = g.integers(-1000, 1000, (5, 16)).astype(float)
    f = ApproximationFile(np.arange(3000), v)
    assert (f.bounds(q) >= q @ f.vectors.T).all() and f.cells.dtype == np.uint8
    ids, found, score = f.search(np.arange(5) + 9000, q, 10)
    for k in range(5):
        s = q[k] @ f.vectors.T
        assert found[ids == k + 9000].tolist() == np.lexsort((np.arange(3000), -s))[:10].tolist()
    # Few exact vectors are read: those that the cells can't rule out.
    assert f.reads < 0.03 * 5 * 3000


def test_few_vectors_of_the_table_are_read(spark):
    v = spark.read.parquet(f"{DATA.replace('0.001', '0.01')}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, whole = np.array([r.vec_id for r in v]), np.floor(1024 * np.array([r.embedding for r in v], float)).astype(np.int64)
    f = ApproximationFile(ids, whole)
    asked = np.flatnonzero(ids % 100 == 0)
    q, found, score = f.search(ids[asked], whole[asked].astype(float), 10)
    for k in asked[:20].tolist():
        s = whole @ whole[k]
        order = [x for x in np.lexsort((ids, -s)).tolist() if x != k][:10]
        assert found[q == ids[k]].tolist() == ids[order].tolist() and score[q == ids[k]].tolist() == s[order].tolist()
    assert f.reads < 0.1 * len(asked) * len(ids)


def test_top_k_repeated_ids():
    ids, vectors = smallest_of_each(np.array([3, 1, 3, 2, 3]), np.array([[5, 1], [0, 0], [5, 0], [1, 1], [6, 0]]))
    assert dict(zip(ids.tolist(), vectors.tolist())) == {1: [0, 0], 2: [1, 1], 3: [5, 0]}


# ---- language model ----
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {k: k + 32 for k in range(65, 91)}


def brute_katz(rows, train):
    token = {i: [*WORDS.findall((t or "").translate(LOWER)), None] for i, t in rows}
    c1, c2, ch, after = collections.Counter(), collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for i, t in token.items():
        if train(i):
            c1.update(t)
            for a, b in zip(["<s>", *t], t):
                c2[a, b] += 1
                ch[a] += 1
                after[a].add(b)
    n, v = sum(c1.values()), len(c1)
    count = lambda c: np.array([0, *(sum(x == r for x in c.values()) for r in range(1, 7))])
    d1, d2 = katz.discounts(count(c1)), katz.discounts(count(c2))
    unknown = 1 - sum(d1[min(x, 6)] * x for x in c1.values()) / n
    p1 = lambda w: d1[min(c1[w], 6)] * c1[w] / n if w in c1 else unknown

    def given(h):
        total = ch[h]
        left = 1 - sum(d2[min(c2[h, w], 6)] * c2[h, w] for w in after[h]) / total
        trim = 1.0
        if left < 1e-12:
            left, trim = 1 / (total + 1), total / (total + 1)
        back = left / (1 - sum(map(p1, after[h])))
        return lambda w: d2[min(c2[h, w], 6)] * c2[h, w] / total * trim if (h, w) in c2 else back * p1(w)

    for h in list(ch)[:20]:  # each history's probabilities have mass 1, one unknown included
        p = given(h)
        assert sum(p(w) for w in c1) + p("<unknown>") == pytest.approx(1)
    out = {}
    for i, t in token.items():
        s = sum(math.log10(given(a)(b) if ch[a] else p1(b)) for a, b in zip(["<s>", *t], t))
        out[i] = (len(t), sum(w in c1 for w in t), n, sum(math.log10((c1[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), s)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_katz_against_brute_force(spark, block_bytes):
    g = random.Random(6)
    rows = [(i, " ".join(g.choice(["the", "the", "of", f"w{g.randint(0, 40)}", f"rare{g.randint(0, 4000)}"]) for _ in range(g.randint(0, 60)))) for i in range(150)]
    rows += [(200, ""), (201, None), (202, "The OF the"), (203, "the " * 3000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, block int")
    got = {r.doc_id: r for r in katz.katz_scores(df, F.col("doc_id") % 4 != 0, block_bytes=block_bytes).collect()}
    want = brute_katz(rows, lambda i: i % 4 != 0)
    assert set(got) == set(want)
    for i, w in want.items():
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert (r.base_score, r.score) == pytest.approx(w[3:])


def test_katz_query(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    want = brute_katz(rows, lambda i: not held(i))
    got = queries.op10_katz(spark, DATA).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.held_out == held(r.doc_id) and (r.n_tokens, r.n_known, r.train_tokens) == want[r.doc_id][:3]
        assert (r.base_score, r.score) == pytest.approx(want[r.doc_id][3:])


def test_katz_odd_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a"), (2, None)], "doc_id long, text string")
    assert katz.katz_scores(df, F.lit(True)).count() == 4
    untaught = katz.katz_scores(df, F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == 0 for r in untaught)
    assert katz.katz_scores(df.limit(0), F.lit(True)).count() == 0
