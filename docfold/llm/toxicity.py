"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word's embedding is the sum of the vectors of its hash and of the hashes of its first bytes.  Filters of
widths 1, 2 and 3 run over the words of the whole text, max pooling keeps each filter's best response, and a
logistic layer reads those.  Thresholds are set for each language; the language comes from the text alone.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, give_back, materialize, mix, prefix_hashes, span_hashes, text_steps, word_spans

WIDTHS = (1, 2, 3)
#: (filter width, place in it) of each of the word tables.
PLACES = [(w, j) for w in WIDTHS for j in range(w)]
#: Nets that calibrate see all folds but one, so more folds bring them nearer to the last net.
FOLDS = 8
#: Folds where there are more rows than one task trains on: half of them are many.
FEW_FOLDS = 2
#: Parts of a block of rows; nets are averaged after each.
ROUNDS = 3
#: Row passes that a net trains for at least: 200 steps of 32 rows.
LEAST_PASSES = 200 * 32
#: Values of a net that are averaged together.
SLICE = 1 << 14
#: Logits are counted in cells of this width.
CELL = 2.0**-10
#: How many rows a threshold's prior counts for.
DRAW = 25
#: Bytes of text that one step scores: each word takes some hundred bytes.
STEP = 1 << 17


def word_features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word (whole, first 4, first 5 bytes), and the word count of each row."""
    data = ascii_lower(data)
    starts, ends, row = word_spans(data, offsets)
    h = prefix_hashes(data)
    out = np.empty((len(starts), 3), np.int32)
    # Marks around a word don't belong to it.
    plain = ((data >= 97) & (data <= 122)) | (data >= 128) | ((data >= 48) & (data <= 57))
    if len(starts):
        before = np.concatenate([[0], np.cumsum(plain)])
        first = np.searchsorted(before, before[starts], "right") - 1
        last = np.searchsorted(before, before[ends], "left")
        some = before[ends] > before[starts]
        starts, ends = np.where(some, first, starts), np.where(some, last, ends)
    for k, n in enumerate((None, 4, 5)):
        stop = ends if n is None else np.minimum(ends, starts + n)
        out[:, k] = mix(span_hashes(h, starts, stop) + np.uint64(k)) % np.uint64(buckets)
    return out, np.bincount(row, minlength=len(offsets) - 1)


class Words(Sequence):
    """Word buckets of rows: in memory up to ``most`` bytes, then in a file of the task."""

    def __init__(self, most: int) -> None:
        self.most, self.size, self.rows, self.file, self.spans = most, 0, [], None, []

    def add(self, ids: np.ndarray, counts: np.ndarray) -> None:
        cut = np.concatenate([[0], np.cumsum(counts)])
        each = [ids[x:y].copy() for x, y in zip(cut[:-1], cut[1:])]
        if self.file is None and self.size + ids.nbytes > self.most:
            self.file = tempfile.TemporaryFile()
            self.size, held, self.rows = 0, self.rows, []
            self._write(held)
        if self.file is None:
            self.rows += each
            self.size += ids.nbytes
        else:
            self._write(each)

    def _write(self, each: list[np.ndarray]) -> None:
        for x in each:
            self.file.write(x.tobytes())
            self.spans.append((self.size, x.nbytes))
            self.size += x.nbytes
        self.file.flush()

    def __len__(self) -> int:
        return len(self.rows) if self.file is None else len(self.spans)

    def __getitem__(self, i: int) -> np.ndarray:
        if self.file is None:
            return self.rows[i]
        at, n = self.spans[i]
        return np.frombuffer(os.pread(self.file.fileno(), n, at), np.int32).reshape(-1, 3)

    def of(self, rows: np.ndarray) -> Words:
        """The same words for some of the rows."""
        some = Words(self.most)
        some.file, some.size = self.file, self.size
        some.rows, some.spans = ([], [self.spans[i] for i in rows]) if self.file is not None else ([self.rows[i] for i in rows], [])
        return some


class Net:
    """The network; ``score_steps`` runs it over whole texts."""

    def __init__(self, buckets: int, dim: int, filters: int, seed: int) -> None:
        g = np.random.default_rng(seed)
        self.buckets, self.filters = buckets, filters
        self.emb = (g.normal(size=(buckets, dim)) * 0.1).astype(np.float32)
        self.kernels = {p: (g.normal(size=(dim, filters)) * (2 / dim / p[0]) ** 0.5).astype(np.float32) for p in PLACES}
        self.bias = np.zeros(len(WIDTHS) * filters, np.float32)
        self.out = (g.normal(size=len(WIDTHS) * filters) * 0.1).astype(np.float32)
        self.out_bias = np.float32(0)
        self.langs: list[str] = []
        self.calibration_rows: dict[str, tuple[int, int]] = {}

    def pooled(self, ids: np.ndarray, counts: np.ndarray, tables: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Max-pooled responses of each row; without ``tables`` also the word at which each was reached."""
        rows, f = len(counts), self.filters
        best = np.zeros((rows, len(WIDTHS) * f), np.float32)
        full = np.flatnonzero(counts)
        at = np.zeros(best.shape, np.int64) if tables is None else None
        if not len(full):
            return best, at
        begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
        if tables is None:
            e = self.emb[ids].sum(1)
            r = np.concatenate([e @ self.kernels[p] for p in PLACES], 1)
        else:
            r = tables[ids[:, 0]]
            r += tables[ids[:, 1]]
            r += tables[ids[:, 2]]
        col = 0
        for k, w in enumerate(WIDTHS):
            y = r[:, col * f : (col + 1) * f].copy()
            for j in range(1, w):
                # A filter that would run past its row's last word sees nothing there.
                y[:-j] += np.where(self._inside(begin, counts, len(ids), j)[:-j, None], r[j:, (col + j) * f : (col + j + 1) * f], 0)
            col += w
            top = np.maximum.reduceat(y, begin[full], axis=0)
            best[full, k * f : (k + 1) * f] = top
            if at is not None:
                hit = y == np.repeat(top, counts[full], axis=0)
                where = np.where(hit, np.arange(len(ids))[:, None], len(ids))
                at[full, k * f : (k + 1) * f] = np.minimum.reduceat(where, begin[full], axis=0)
        return best, at

    @staticmethod
    def _inside(begin: np.ndarray, counts: np.ndarray, n: int, j: int) -> np.ndarray:
        ok = np.ones(n, bool)
        ends = (begin + counts)[counts > 0]
        for d in range(1, j + 1):
            back = ends - d
            ok[back[back >= 0]] = False
        return ok

    def fit(self, ids: Sequence[np.ndarray], labels: np.ndarray, epochs: int, rate: float, seed: int, most_steps: int | None = None, moments: dict | None = None, classes: tuple[int, int] | None = None, least: int = LEAST_PASSES) -> dict:
        """Adagrad on the logistic loss, classes weighing alike; ``most_steps`` ends it early.

        Few rows are gone through more often than ``epochs`` times, until there are ``least`` row passes.  ``moments`` is
        what an earlier call returned, and ``classes`` the clean and toxic rows of all, where these are a part of them.
        """
        g = np.random.default_rng(seed)
        f, n = self.filters, len(ids)
        moments = {} if moments is None else moments
        clean, toxic = classes or ((1 - labels).sum(), labels.sum())
        weight = np.where(labels == 1, (clean + toxic) / 2 / max(1, toxic), (clean + toxic) / 2 / max(1, clean))

        def adagrad(key, x: np.ndarray, grad: np.ndarray) -> np.ndarray:
            m = moments.setdefault(key, np.full_like(x, 1e-3))
            m += grad * grad
            return x - rate * grad / np.sqrt(m)

        steps = 0
        for _ in range(max(epochs, -(-least // max(n, 1)))):
            order = g.permutation(n)
            for lo in range(0, n, 32):
                if steps == most_steps:
                    return moments
                steps += 1
                pick = order[lo : lo + 32]
                rows = [ids[i] for i in pick]
                counts = np.array([len(x) for x in rows])
                if not counts.sum():
                    continue
                words = np.concatenate(rows)
                best, at = self.pooled(words, counts)
                act = np.maximum(best + self.bias, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ self.out + self.out_bias, -30, 30)))
                d = ((p - labels[pick]) * weight[pick] / len(pick)).astype(np.float32)
                d_act = d[:, None] * self.out * (act > 0)
                self.out, self.out_bias = adagrad("out", self.out, act.T @ d + 1e-4 * self.out), adagrad("ob", np.array([self.out_bias]), np.array([d.sum()]))[0]
                self.bias = adagrad("bias", self.bias, d_act.sum(0))
                last = np.cumsum(counts)
                touched, grads = [], []
                for k, w in enumerate(WIDTHS):
                    for j in range(w):
                        pos = at[:, k * f : (k + 1) * f] + j
                        ok = pos < last[:, None]
                        gr = np.where(ok, d_act[:, k * f : (k + 1) * f], 0).reshape(-1)
                        pos = np.where(ok, pos, 0).reshape(-1)
                        e = self.emb[words[pos]].sum(1)
                        kern = self.kernels[w, j]
                        col = np.tile(np.arange(f), len(pick))
                        live = gr != 0
                        d_k = np.zeros_like(kern.T)
                        np.add.at(d_k, col[live], e[live] * gr[live, None])
                        touched.append(words[pos[live]])
                        grads.append(kern.T[col[live]] * gr[live, None])
                        self.kernels[w, j] = adagrad((w, j), kern, d_k.T)
                where = np.concatenate(touched).reshape(-1)
                if len(where):
                    uniq, inv = np.unique(where, return_inverse=True)
                    g_e = np.zeros((len(uniq), self.emb.shape[1]), np.float32)
                    np.add.at(g_e, inv, np.repeat(np.concatenate(grads), 3, axis=0))
                    m = moments.setdefault("emb", np.full_like(self.emb, 1e-3))
                    m[uniq] += g_e * g_e
                    self.emb[uniq] -= rate * g_e / np.sqrt(m[uniq])
        return moments

    def pack(self, moments: dict) -> np.ndarray:
        """Parameters and moments in one vector; a bucket's moments are one value, their mean."""
        parts = {"emb": self.emb, **self.kernels, "bias": self.bias, "out": self.out, "ob": np.array([self.out_bias])}
        held = {k: moments.get(k, np.full_like(x, 1e-3)) for k, x in parts.items()}
        held["emb"] = held["emb"].mean(1)
        return np.concatenate([np.asarray(x, np.float32).ravel() for x in (*parts.values(), *held.values())])

    def unpack(self, vector: np.ndarray) -> dict:
        """Takes the parameters that :meth:`pack` gave; returns the moments."""
        at = 0

        def take(x: np.ndarray) -> np.ndarray:
            nonlocal at
            at += x.size
            return vector[at - x.size : at].reshape(x.shape).astype(np.float32)

        self.emb, self.kernels = take(self.emb), {p: take(k) for p, k in self.kernels.items()}
        self.bias, self.out, self.out_bias = take(self.bias), take(self.out), take(np.zeros(1))[0]
        moments = {"emb": np.repeat(take(self.emb[:, :1]), self.emb.shape[1], axis=1), **{p: take(k) for p, k in self.kernels.items()}}
        return moments | {"bias": take(self.bias), "out": take(self.out), "ob": take(np.zeros(1))}

    def tables(self) -> np.ndarray:
        """Each bucket's response to each filter place: forward runs gather these rows."""
        return np.concatenate([self.emb @ self.kernels[p] for p in PLACES], 1)

    def logits(self, best: np.ndarray) -> np.ndarray:
        return np.maximum(best + self.bias, 0) @ self.out + self.out_bias

    def learn_langs(self, langs: list[str], seen: np.ndarray) -> None:
        """Word statistics of each language: ``seen`` counts the words of each bucket and language."""
        self.langs = langs
        seen = (seen if langs else np.zeros((self.buckets, 1))) + 0.1
        self.lang_tables = np.log(seen / seen.sum(0)).astype(np.float32)

    def calibrate(self, guess: np.ndarray, low: np.ndarray, high: np.ndarray, toxic: np.ndarray, rows: np.ndarray) -> None:
        """A threshold for each language that the texts seem to be in; the last is for texts of no language.

        Each entry is a cell of logits from ``low`` to ``high`` with its toxic and all rows.  ``calibration_rows`` holds
        each language's toxic and clean rows.  Its threshold is drawn towards the overall one, and that towards even
        odds, as if by DRAW rows more of the rarer class.
        """
        overall = best_threshold(low, high, toxic, rows, 0.0)
        own = [guess == k for k in range(max(1, len(self.langs)))]
        self.calibration_rows = {x: (int(toxic[m].sum()), int((rows - toxic)[m].sum())) for x, m in zip(self.langs, own)}
        self.thresholds = np.array([best_threshold(low[m], high[m], toxic[m], rows[m], overall) for m in own] + [overall])

    def lang_of(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Index of each row's likeliest language; -1 without words."""
        out = np.full(len(counts), -1)
        full = np.flatnonzero(counts)
        if len(full) and self.langs:
            begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
            out[full] = np.add.reduceat(self.lang_tables[ids[:, 0]], begin[full], axis=0).argmax(1)
        return out


def best_threshold(low: np.ndarray, high: np.ndarray, toxic: np.ndarray, rows: np.ndarray, prior: float) -> float:
    """The middle of the gap between cells of logits at which F1 is best, drawn towards ``prior``.

    With n rows of the rarer class, the gap counts n times and ``prior`` DRAW times; so it is ``prior`` without any.
    """
    n = int(min(toxic.sum(), (rows - toxic).sum()))
    if not n:
        return prior
    # Languages have the same cells.
    _, at = np.unique(np.floor(-high / CELL), return_inverse=True)
    toxic, rows = np.bincount(at, toxic), np.bincount(at, rows)
    top, bottom = np.full(len(rows), -np.inf), np.full(len(rows), np.inf)
    np.maximum.at(top, at, high)
    np.minimum.at(bottom, at, low)
    hit = np.cumsum(toxic)
    k = int((2 * hit / (np.cumsum(rows) + toxic.sum())).argmax())
    found = float((bottom[k] + top[k + 1]) / 2) if k + 1 < len(rows) else float(bottom[k]) - 0.5
    return (n * found + DRAW * prior) / (n + DRAW)


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str | None = "lang", n_toxic: int = 1500, n_clean: int = 3000, max_train_bytes: int = 32 << 20, buckets: int = 1 << 16, dim: int = 16, filters: int = 8, epochs: int = 6, seed: int = 7) -> Net:
    """Trains on every labelled row, whole texts of any length; word statistics and thresholds come from every one too.

    Up to ``n_toxic + n_clean`` rows are trained on together for ``epochs``.  More rows are cut by a hash of id and text
    into blocks of about eight times as many at most, and each block into ROUNDS parts.  In a round every block trains the
    nets of the round before on its next part, and what the blocks have changed is averaged, each value over the
    blocks that changed it.  A task holds the words of ``max_train_bytes`` of text and keeps more in a file.

    Each row is scored for the thresholds, within tasks, by a net, trained likewise, that hasn't seen its fold of text
    hashes: of FOLDS folds where there is one block, of FEW_FOLDS else.  Logits are counted by language and cell.

    Only nets, whose size is fixed, and these counts reach the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("")) if lang_col else F.lit("")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), lang.alias("lang"))
    given = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("label in (0, 1)").distinct()
    # Equal texts are in one fold, so that no net has seen a copy of what it is held against.
    # Texts are shuffled at every size: labels, which grow with them, are never sent to all tasks.
    known = materialize(rows.join(given.hint("merge"), "doc_id").select("text", "lang", "label", F.xxhash64(F.lit(17), "doc_id").alias("at"), F.xxhash64("text").alias("hash")))
    total = {0: 0, 1: 0} | {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    n, most = sum(total.values()), n_toxic + n_clean
    few = n <= most
    folds, rounds, blocks = (FOLDS, 1, 1) if few else (FEW_FOLDS, ROUNDS, -(-n // (8 * most)))
    passes = epochs if few else -(-max(epochs * most, LEAST_PASSES) // -(-n // blocks))

    def nets(shared, turn: int) -> Net:
        net = Net(buckets, dim, filters, seed)
        net.unpack(shared[turn])
        return net

    def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            names = np.array(b.column("lang").to_pylist(), object)
            for lo, hi, data, offsets in text_steps(b.column("text"), STEP):
                ids, counts = word_features(data, offsets, buckets)
                of = np.repeat(names[lo:hi], counts)
                for x in set(names[lo:hi]):
                    seen[x] = seen.get(x, 0) + np.bincount(ids[of == x, 0], minlength=buckets)
        for x, count in seen.items():
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([x] * len(at), pa.string()), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(count[at].astype(np.int64))})
        give_back()

    spoken = sorted(r[0] for r in known.filter("lang <> ''").select("lang").distinct().collect())
    words = known.filter("lang <> ''").select("text", "lang").mapInArrow(counts_of, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    seen = np.zeros((buckets, len(spoken)))
    seen[np.asarray(words["bucket"]), np.searchsorted(np.array(spoken, object), np.array(words["lang"].to_pylist(), object)) if spoken else np.zeros(0, int)] = np.asarray(words["n"])

    # Of few rows a task is a net, which reads all; else it is a block, and trains all nets on its rows of a round.
    part = F.pmod(F.xxhash64(F.lit(23), "at", "hash"), F.lit(blocks * rounds)).cast("int")
    task = F.explode(F.sequence(F.lit(0), F.lit(folds))) if few else F.floor(part / rounds).cast("int")
    dealt = known.withColumn("fold", F.pmod("hash", F.lit(folds)).cast("int")).withColumn("round", part % rounds).withColumn("task", task)
    start = Net(buckets, dim, filters, seed).pack({})
    now = [start] * (folds + 1)
    for k in range(rounds):
        shared = spark.sparkContext.broadcast(now)

        def train(batches: Iterator[pa.RecordBatch], k: int = k, shared=shared) -> Iterator[pa.RecordBatch]:
            held, y, fold, own = Words(2 * max_train_bytes), [], [], None
            for b in batches:
                for _, _, data, offsets in text_steps(b.column("text"), STEP):
                    held.add(*word_features(data, offsets, buckets))
                y.append(np.array(b.column("label"), np.float32))
                fold.append(np.array(b.column("fold")))
                own = b.column("task")[0].as_py() if b.num_rows else own
            if own is not None:
                y, fold = np.concatenate(y), np.concatenate(fold)
                for turn in [own] if few else range(folds + 1):
                    use = np.flatnonzero(fold != turn)
                    net = Net(buckets, dim, filters, seed)
                    moments = net.unpack(shared.value[turn])
                    if few:
                        moments = net.fit(held.of(use), y[use], passes, 0.05, seed)
                    else:
                        moments = net.fit(held.of(use), y[use], passes, 0.05, seed + k, moments=moments, classes=(total[0], total[1]), least=0)
                    change = net.pack(moments) - shared.value[turn]
                    parts = [change[x : x + SLICE].tobytes() for x in range(0, len(change), SLICE)]
                    yield pa.RecordBatch.from_pydict({"turn": pa.array([turn] * len(parts), pa.int32()), "part": pa.array(range(len(parts)), pa.int32()), "task": pa.array([own] * len(parts), pa.int32()), "change": pa.array(parts, pa.binary())})
            del held, y, fold
            give_back()

        def average(changes: pa.Table) -> pa.Table:
            total, changed = 0, 0
            for x in changes.sort_by("task")["change"]:
                x = np.frombuffer(x.as_buffer(), np.float32)
                total, changed = total + x.astype(float), changed + (x != 0)
            mean = (total / np.maximum(changed, 1)).astype(np.float32)
            return pa.table({"turn": changes["turn"][:1], "part": changes["part"][:1], "change": pa.array([mean.tobytes()], pa.binary())})

        turn = dealt.filter(F.col("round") == k).repartitionById(folds + 1 if few else blocks, "task").sortWithinPartitions("label", "at", "hash").select("text", "label", "fold", "task")
        changes = turn.mapInArrow(train, "turn int, part int, task int, change binary").groupBy("turn", "part").applyInArrow(average, "turn int, part int, change binary")
        now = [x.copy() for x in now]
        # The driver holds the changes of one partition at a time.
        for r in changes.toLocalIterator():
            now[r.turn][r.part * SLICE : (r.part + 1) * SLICE] += np.frombuffer(r.change, np.float32)
        shared.destroy()

    net = nets(now, folds)
    net.learn_langs(spoken, seen)
    held_out = spark.sparkContext.broadcast(now[:folds])
    del now, start, seen, words

    def unseen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready: dict[int, tuple[Net, np.ndarray]] = {}
        for b in batches:
            fold, label = np.array(b.column("fold")), np.array(b.column("label"))
            for lo, hi, data, offsets in text_steps(b.column("text"), STEP):
                ids, counts = word_features(data, offsets, buckets)
                turns, logit = fold[lo:hi], np.zeros(hi - lo)
                of = np.repeat(turns, counts)
                for turn in np.unique(turns):
                    if turn not in ready:
                        net = nets(held_out.value, turn)
                        ready[turn] = net, net.tables()
                    net, tables = ready[turn]
                    logit[turns == turn] = net.logits(net.pooled(ids[of == turn], counts[turns == turn], tables)[0])
                yield pa.RecordBatch.from_pydict({"guess": pa.array(guesser.value.lang_of(ids, counts)), "label": pa.array(label[lo:hi]), "logit": pa.array(logit)})
        ready.clear()
        give_back()

    guesser = spark.sparkContext.broadcast(net)
    scored = known.select("text", "label", F.pmod("hash", F.lit(folds)).cast("int").alias("fold")).mapInArrow(unseen, "guess long, label int, logit double")
    cell = F.floor(-F.col("logit") / CELL)
    cells = scored.groupBy("guess", cell.alias("cell")).agg(F.min("logit").alias("low"), F.max("logit").alias("high"), F.sum("label").alias("toxic"), F.count(F.lit(1)).alias("n")).collect()
    of = lambda name, t: np.array([r[name] for r in cells], t)
    net.calibrate(of("guess", int), of("low", float), of("high", float), of("toxic", int), of("n", int))
    held_out.destroy()
    guesser.destroy()
    give_back()
    return net


def score_toxicity(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, score`` (0 to 1; 0.5 is the language's threshold) for each row, over its whole text.

    Null and empty texts score as texts without words; repeated rows score alike; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value
        for b in batches:
            scores = []
            for _, _, data, offsets in text_steps(b.column(1), STEP):
                ids, counts = word_features(data, offsets, model.buckets)
                logit = model.logits(model.pooled(ids, counts, tables)[0])
                logit = logit - model.thresholds[model.lang_of(ids, counts)]
                logit[counts == 0] = -5.0
                scores.append(1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(scores) if scores else np.zeros(0))], ["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, net: Net, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, that score below ``threshold``; scored in place, without a join."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((net, net.tables()))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, tables = shared.value
        for b in batches:
            keep = []
            for _, _, data, offsets in text_steps(b.column(at), STEP):
                ids, counts = word_features(data, offsets, model.buckets)
                logit = model.logits(model.pooled(ids, counts, tables)[0]) - model.thresholds[model.lang_of(ids, counts)]
                keep.append((counts == 0) | (1 / (1 + np.exp(-np.clip(logit.astype(np.float64), -30, 30))) < threshold))
            if keep:
                yield b.filter(pa.array(np.concatenate(keep)))

    return docs.mapInArrow(run, docs.schema)
