"""The pipeline's stages, each on its own input, against plain versions."""

import collections
import zlib

import numpy as np
import public_tokenizers
from conftest import DATA
from test_dedup import brute_components, brute_repeats
from tokenizers import Tokenizer

import corpus_pipeline


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "minhash_dedup", "suffix_dedup", "packing"]
    from docfold.llm.common import materialize

    outs = [docs]
    for _, stage in corpus_pipeline.STAGES:
        outs.append(materialize(stage(spark, outs[-1], DATA)))
    start, mild, exact, near, cut, packed = outs
    for df in (mild, exact, near, cut):
        assert df.columns == columns
    assert mild.exceptAll(start).count() == 0 and mild.count() > 0.5 * start.count()
    first = {}
    for r in sorted(mild.collect(), key=lambda r: r.doc_id):
        first.setdefault(r.text, r)
    assert sorted(exact.collect()) == sorted(first.values())
    rows = [(r.doc_id, r.text) for r in exact.collect()]
    assert sorted(r.doc_id for r in near.collect()) == sorted(i for i, (_, c) in brute_components(rows, 80).items() if i == c)
    want = brute_repeats([(r.doc_id, r.text) for r in near.collect()])
    got = {r.doc_id: r for r in cut.collect()}
    assert set(got) == set(want)
    for i, (n, gone, _, _) in want.items():
        left = len(got[i].text.encode())
        assert 0 <= n - gone - left <= 6 * 40 and got[i].n_chars == len(got[i].text)
        assert gone or left == n
    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = collections.defaultdict(list)
    for r in packed.collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(got)
    for i, r in got.items():
        ids = np.array([*tk.encode(r.text, add_special_tokens=False).ids, 0], "<u4")
        own = sorted(pieces[i], key=lambda p: p.start)
        assert sum(p.length for p in own) == len(ids) and all(p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes()) for p in own)


def test_run(spark):
    out = corpus_pipeline.run(spark, DATA)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0


def test_stages_with_no_rows_and_with_clashing_columns(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    own = ("component_id", "kept", "_stays", "_sha", "_rows", "block", "score", "label", "cell", "at", "carried", "h", "node")
    more = docs.limit(12).withColumns({c: F.lit(c) for c in own}).withColumn("text", F.when(F.col("doc_id") % 5 != 0, F.col("text")))
    for rows, n in ((more.limit(0), 0), (more, 12)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, DATA)
            if name == "packing":
                assert out.select("doc_id").distinct().count() == n
            else:
                assert out.columns == rows.columns and out.count() <= n
                assert all(r[c] == c for r in out.select(*own).collect() for c in own)
