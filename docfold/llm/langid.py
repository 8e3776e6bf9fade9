"""Language identification: interpolated Kneser-Ney character models, one per language.

The models of all languages share one sorted array of n-gram keys per order, with a column of log
probabilities (and interpolation weights) per language.  A text goes to the language with the lowest
length-normalised cross-entropy; texts that fit no language are rejected by a calibrated limit.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, materialize, text_steps

ORDER = 3
#: Bits of one character in a packed key: three code points fit 63 bits.
BITS = 21
DISCOUNT = 0.75
#: A language's limit leans on the limit of all rows as if it had that many more rows with it.
LEANS = 20


def characters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points of all texts, each after two blanks, and the row of each."""
    low = [t.lower() for t in texts]
    code = np.frombuffer("".join("  " + t for t in low).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    return code, np.repeat(np.arange(len(low)), [len(t) + 2 for t in low])


def grams(code: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed 3-character keys of each character with its two before it, and the row of each."""
    if len(code) < ORDER:
        return np.zeros(0, np.uint64), np.zeros(0, int)
    b = np.uint64(BITS)
    keys = (code[:-2] << np.uint64(2 * BITS)) | (code[1:-1] << b) | code[2:]
    inside = row[:-2] == row[2:]
    return keys[inside], row[2:][inside]


class LanguageModels:
    """Sorted keys of each order and, per language: log10 probability of the seen, weight left for lower orders."""

    def __init__(self, langs: list[str], counts: list[dict[int, int]]) -> None:
        self.langs = langs
        low = np.uint64((1 << BITS) - 1)
        pair = np.uint64((1 << 2 * BITS) - 1)
        per = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], float)) for c in counts]
        self.keys = [np.zeros(0, np.uint64)] * 4
        self.prob = [np.zeros((0, len(langs)))] * 4
        self.left = [np.zeros((0, len(langs)))] * 4
        seen3 = np.unique(np.concatenate([np.zeros(0, np.uint64), *[k for k, _ in per]]))
        seen2 = np.unique(np.concatenate([seen3 & pair, seen3 >> np.uint64(BITS)]))
        seen1 = np.unique(np.concatenate([seen2 & low, seen2 >> np.uint64(BITS)]))
        alphabet = len(seen1) + 1
        shape = (len(seen1), len(langs))
        p1, p2, p3 = np.zeros(shape), np.zeros((len(seen2), len(langs))), np.zeros((len(seen3), len(langs)))
        l1, l2 = np.ones(shape), np.ones((len(seen2), len(langs)))
        self.base = np.zeros(len(langs))
        for j, (k3, c3) in enumerate(per):
            # Lower orders count in how many contexts a gram continues, not how often it occurs.
            k2, c2 = np.unique(k3 & pair, return_counts=True)
            k1, c1 = np.unique(k2 & low, return_counts=True)
            total1 = max(c1.sum(), 1)
            self.base[j] = (DISCOUNT * len(k1) / total1 if len(k1) else 1.0) / alphabet
            p1[:, j] = self.base[j]
            p1[np.searchsorted(seen1, k1), j] += (c1 - DISCOUNT) / total1
            for keys, c, seen, lower, below, left, p, ctx_seen in ((k2, c2, seen2, p1, seen1, l1, p2, seen1), (k3, c3, seen3, p2, seen2, l2, p3, seen2)):
                ctx = keys >> np.uint64(BITS)
                u, inv = np.unique(ctx, return_inverse=True)
                tot = np.bincount(inv, weights=c)
                kinds = np.bincount(inv)
                left[np.searchsorted(ctx_seen, u), j] = DISCOUNT * kinds / tot
                tail = seen & (low if seen is seen2 else pair)
                head = seen >> np.uint64(BITS)
                weight = left[np.searchsorted(ctx_seen, head), j]
                p[:, j] = weight * lower[np.searchsorted(below, tail), j]
                at = np.searchsorted(seen, keys)
                p[at, j] += (c - DISCOUNT) / tot[inv]
        self.keys[1], self.keys[2], self.keys[3] = seen1, seen2, seen3
        self.prob[1], self.prob[2], self.prob[3] = (x.astype(np.float32) for x in (p1, p2, p3))
        self.left[1], self.left[2] = (x.astype(np.float32) for x in (l1, l2))
        self.limits = np.full(len(langs), np.inf)

    def _find(self, order: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = self.keys[order]
        at = np.minimum(np.searchsorted(have, keys), max(len(have) - 1, 0))
        return at, (have[at] == keys) if len(have) else np.zeros(len(keys), bool)

    def _lookup(self, order: int, keys: np.ndarray) -> np.ndarray:
        """Probability of each key's last character in each language; unseen keys fall to shorter contexts."""
        if order == 0:
            return np.tile(self.base, (len(keys), 1))
        at, hit = self._find(order, keys)
        out = self.prob[order][at] if len(self.keys[order]) else np.zeros((len(keys), len(self.langs)))
        if not hit.all():
            miss = keys[~hit]
            lower = self._lookup(order - 1, miss & np.uint64((1 << (order - 1) * BITS) - 1))
            if order > 1:
                ctx, known = self._find(order - 1, miss >> np.uint64(BITS))
                lower = lower * np.where(known[:, None], self.left[order - 1][ctx], 1.0)
            out[~hit] = lower
        return out

    def cross_entropy(self, texts: list[str]) -> np.ndarray:
        """Mean negative log10 probability of a character, rows x languages; whole texts."""
        code, row = characters(texts)
        keys, row = grams(code, row)
        if not len(keys):
            return np.zeros((len(texts), len(self.langs)))
        uniq, inv = np.unique(keys, return_inverse=True)
        bits = -np.log10(np.maximum(self._lookup(ORDER, uniq), 1e-12)).astype(np.float32)
        n = np.bincount(row, minlength=len(texts))
        return np.stack([np.bincount(row, weights=bits[inv, j], minlength=len(texts)) for j in range(len(self.langs))], 1) / np.maximum(n, 1)[:, None]


def train_langid(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", n_per_lang: int = 500, reject: float = 0.99) -> LanguageModels:
    """Fits on at most ``n_per_lang`` rows of every language that occurs; a model's size grows with the languages.

    Rows are chosen by the order of a hash of their ids; their whole texts are counted in tasks and only summed
    counts reach the driver.  The rejection is calibrated on texts that a model hasn't seen: each half of the
    sample (by a hash of the text) is measured by models of the other half, and a language's limit is the
    cross-entropy that the share ``reject`` of its rows stays below, drawn towards the limit of all rows together the
    more, the fewer rows it has: ``(n * own + LEANS * overall) / (n + LEANS)``.  Rows with null text or language take
    no part; where none is left, an empty table among them, no language is known and every text is ``und``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text is not null and lang is not null")
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    langs = sorted(sizes)
    if not langs:
        return LanguageModels([], [])
    # Twice the share that is needed passes a filter by hash, so that no language is ranked as a whole.
    rate = spark.createDataFrame([(x, 2 * n_per_lang / n) for x, n in sizes.items()], "lang string, rate double")
    at = F.xxhash64(F.lit(17), F.col("doc_id"))
    likely = rows.join(F.broadcast(rate), "lang").filter(at / F.lit(2.0**64) + 0.5 < F.col("rate"))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(at, "doc_id", F.xxhash64("text")))
    half = F.pmod(F.xxhash64(F.lit(3), "text"), F.lit(2)).cast("int")
    sample = materialize(likely.withColumn("nth", nth).filter(F.col("nth") <= n_per_lang).select("lang", "text", half.alias("half")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = list(zip(b.column("lang").to_pylist(), b.column("half").to_pylist()))
            for one in set(kinds):
                texts = [t for t, x in zip(b.column("text").to_pylist(), kinds) if x == one]
                keys, n = np.unique(grams(*characters(texts))[0], return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([one[0]] * len(keys), pa.string()), "half": pa.array([one[1]] * len(keys), pa.int32()), "key": keys.astype(np.int64), "n": n.astype(np.int64)})

    got = sample.mapInArrow(count, "lang string, half int, key long, n long").groupBy("lang", "half", "key").agg(F.sum("n").alias("n")).toPandas()
    by = {k: dict(zip(g["key"], g["n"])) for k, g in got.groupby(["lang", "half"])}
    halves = [LanguageModels(langs, [by.get((x, k), {}) for x in langs]) for k in (1, 0)]
    every = [Counter(by.get((x, 0), {})) + Counter(by.get((x, 1), {})) for x in langs]
    models = LanguageModels(langs, every)
    unseen = materialize(sample.mapInArrow(_entropies(spark.sparkContext.broadcast(halves)), "lang string, h double"))
    limit = F.percentile("h", F.lit(reject)).alias("q")
    own = {r.lang: (r.n, r.q) for r in unseen.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), limit).collect()}
    overall = unseen.agg(limit).first().q
    drawn = lambda n, q: (n * q + LEANS * overall) / (n + LEANS)
    models.limits = np.array([np.inf if overall is None else drawn(*own.get(x, (0, 0.0))) for x in langs])
    return models


def _entropies(halves):
    """Best cross-entropy of each row by the models of the half that it isn't in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, models in enumerate(halves.value):
                own = b.filter(pc.equal(b.column("half"), k))
                yield pa.RecordBatch.from_pydict({"lang": own.column("lang"), "h": models.cross_entropy(own.column("text").to_pylist()).min(1)})

    return run


def identify_language(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, cross_entropy, rejected`` for each row, over its whole text.

    ``lang_pred`` is ``und`` with score 0 where the text is null or has no letter, or no language is known; ``score`` is the share of
    the chosen language when cross-entropies over up to 50 characters compete.  ``rejected`` marks texts whose
    best cross-entropy is over the limit of that language; they keep their nearest language.  Ties go to the first language by
    name.  Repeated rows get equal answers; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            column = b.column(1)
            if not m.langs:
                n = b.num_rows
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(["und"] * n, pa.string()), pa.array(np.zeros(n)), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])
                continue
            letters = np.array(pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False))
            entropy, size = [np.zeros((0, len(m.langs)))], np.array(pc.fill_null(pc.utf8_length(column), 0))
            for lo, hi, _, _ in text_steps(column):
                entropy.append(m.cross_entropy([t or "" for t in column.slice(lo, hi - lo).to_pylist()]))
            h = np.concatenate(entropy)
            if not len(h):
                continue
            best = h.argmin(1)
            low = h.min(1)
            share = 1 / np.power(10.0, -(h - low[:, None]) * np.clip(size, 1, 50)[:, None]).sum(1)
            names = np.array(m.langs, object)[best]
            names[~letters] = "und"
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0)), pa.array(low), pa.array(letters & (low > m.limits[best]))],
                ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, cross_entropy double, rejected boolean")
