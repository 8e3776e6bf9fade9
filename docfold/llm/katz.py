"""Language-model scoring: a Katz backoff bigram model over words, with Good-Turing discounts.

    p(w | h) = d(c(h w)) c(h w) / c(h)    if c(h w) > 0
             = a(h) p(w)                  else, where a(h) gives seen and unseen words together mass 1
    p(w)     = d(c(w)) c(w) / N           if c(w) > 0
             = what discounting has left  for the one unknown word

Counts are kept in tables partitioned by hash range: words by the word, bigrams by their history (bigrams of
the most frequent histories by both words).  Blocks of documents ask the ranges about their distinct words,
then about their distinct bigrams, and put the answers together token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import pack, range_of, unpack, with_blocks
from .common import ascii_lower, give_back, mix, prefix_hashes, bounded_batches, span_hashes, text_steps, word_spans

#: Counts up to this are discounted.
TOP = 5
END = np.uint64(0x5E9D0F1C2B3A4857)
START = np.uint64((1 << 63) - 1)
#: Sums that a history needs: total, its followers' unigram counts above TOP, then followers by unigram and by bigram count 1..TOP.
SUMS = 2 + 2 * TOP


class BlockTokens:
    """A block's tokens: rows in the order of their ids, each text's words and one end."""

    def __init__(self, table: pa.Table) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table = table
        rows = table.num_rows
        # Bytes are hashed in steps; only the words' hashes stay.
        words, row = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for lo, _, data, offsets in text_steps(table.column("text")):
            data = ascii_lower(data)
            starts, ends, at = word_spans(data, offsets)
            words.append(mix(span_hashes(prefix_hashes(data), starts, ends)))
            row.append(at + lo)
        words, row = np.concatenate(words), np.concatenate(row)
        n = np.bincount(row, minlength=rows) + 1
        close = np.cumsum(n) - 1
        token = np.empty(int(n.sum()), np.uint64)
        inner = np.ones(len(token), bool)
        inner[close] = False
        token[inner], token[close] = words, END
        self.counts = n
        self.row = np.repeat(np.arange(rows), n)
        self.train = np.array(table.column("carried").combine_chunks().field("train").fill_null(False) if rows else [], bool)
        #: Distinct words, which one each token is, and which one comes before it (-1: the start).
        self.words, self.word = np.unique(token, return_inverse=True)
        self.before = np.concatenate([[-1], self.word[:-1]])
        self.before[close[:-1] + 1] = -1

    def learned(self, which: np.ndarray, kinds: int) -> np.ndarray:
        return np.bincount(which, weights=self.train[self.row], minlength=kinds).astype(np.int64)


def _cuts(r: np.ndarray, ranges: int) -> list[tuple[int, int, int]]:
    """(range, first, stop) of the ranges that occur in ascending ``r``."""
    cut = np.searchsorted(r, np.arange(ranges + 1)).tolist()
    return [(k, cut[k], cut[k + 1]) for k in range(ranges) if cut[k] < cut[k + 1]]


def discounts(times: np.ndarray) -> np.ndarray:
    """Katz's Good-Turing discounts d[r] for r <= TOP from counts of counts n[r], r <= TOP + 1; d is 1 above.

    Where counts of counts don't give a value in (0, 1), r - 1/2 of r is used instead.
    """
    d = np.ones(TOP + 2)
    n = np.append(times, np.zeros(max(0, TOP + 2 - len(times)))).astype(float)
    cut = (TOP + 1) * n[TOP + 1] / n[1] if n[1] else 0.0
    for r in range(1, TOP + 1):
        star = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
        d[r] = (star - cut) / (1 - cut) if cut != 1 else 0.0
        if not 0 < d[r] < 1:
            d[r] = (r - 0.5) / r
    return d


def _spread(x: np.ndarray) -> np.ndarray:
    return mix(x.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019))


def katz_scores(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20, range_bytes: int = 16 << 20) -> DataFrame:
    """``doc_id, train, n_tokens, n_known, train_tokens, base_score, score`` for each row, over its whole text.

    ``train`` tells which rows the model learns from (null: not).  Tokens are words ``[^\\x20\\x09-\\x0D]+`` after
    A-Z to a-z, then one end.  ``score`` is the model's log10 probability of the text; ``base_score`` that of
    add-0.1 unigrams over the training words and one unknown; ``n_known`` counts tokens seen in training and
    ``train_tokens`` those of training.

    Null and empty texts have the end alone.  Repeated rows are each learned from and scored.  Ids are integers;
    nulls are kept.  Without training rows every word is unknown and probabilities are 1.  An empty table gives
    no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, n_blocks, ranges = with_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(train, F.lit(False)).alias("train")), "doc_id", "text", block_bytes, range_bytes, ("train",))
    by_block = rows.groupBy("block")
    form = "block long, kind int, at long, data binary, heads binary"

    def ask_words(key: tuple, table: pa.Table) -> pa.Table:
        t = BlockTokens(table)
        r = range_of(t.words, ranges)
        order = np.argsort(r, kind="stable")
        n = t.learned(t.word, len(t.words))[order].astype(np.uint32)
        parts = [(k, pack(t.words[order[a:b]], n[a:b])) for k, a, b in _cuts(r[order], ranges)]
        return pa.table({"range": pa.array([k for k, _ in parts], pa.int32()), "block": pa.array([key[0].as_py()] * len(parts), pa.int64()), "data": pa.array([d for _, d in parts], pa.binary())})

    def tell_words(key: tuple, table: pa.Table) -> pa.Table:
        """Count and number of each asked word, to its block; the range's sums under block -1."""
        parts = [unpack(x, "u8", "u4") for x in table.column("data").to_pylist()]
        words, which = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        total = np.bincount(which, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
        number = (np.cumsum(total > 0) - 1) * ranges + key[0].as_py()
        cut = np.cumsum([len(p[0]) for p in parts])[:-1]
        blobs = [pack(total[k], number[k]) for k in np.split(which, cut)]
        times = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[: TOP + 2]
        own = pack(np.concatenate([times, [total.sum(), (total > 0).sum()]]).astype(np.int64))
        n = len(parts)
        return pa.table({"block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "kind": pa.array([0] * n + [9], pa.int32()), "at": pa.array([key[0].as_py()] * (n + 1), pa.int64()), "data": pa.array([*blobs, own], pa.binary()), "heads": pa.nulls(n + 1, pa.binary())})

    def told_words(t: BlockTokens, info: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Count and number of each of the block's words, and the model's unigram sums."""
        r = range_of(t.words, ranges)
        count, number = np.zeros(len(t.words), np.int64), np.zeros(len(t.words), np.int64)
        by_range = {a: d for k, a, d in zip(*(info.column(c).to_pylist() for c in ("kind", "at", "data"))) if k == 0}
        for k in np.unique(r).tolist():
            mine = np.flatnonzero(r == k)
            count[mine], number[mine] = unpack(by_range[k], "i8", "i8")
        return count, number, unpack(_one(info, 1), "i8")[0]

    def pairs_of(t: BlockTokens, count: np.ndarray, number: np.ndarray, whole: np.ndarray) -> Pairs:
        w = len(t.words) + 1
        known_head = (t.before < 0) | (count[t.before] > 0)
        pair = np.where((count[t.word] > 0) & known_head, (t.before + 1) * w + t.word, -1)
        kinds, which = np.unique(pair, return_inverse=True)
        skip = int(len(kinds) > 0 and kinds[0] == -1)
        before, word = kinds[skip:] // w - 1, kinds[skip:] % w
        learned = t.learned(which, len(kinds))[skip:]
        # A history that takes more than a range's share of the tokens is spread over the ranges.
        heads = np.unique(t.before[known_head])
        hot = (heads < 0) | (count[heads] * ranges > whole[TOP + 2])
        head_number = np.where(heads < 0, np.int64(-1), number[heads])
        at = np.searchsorted(heads, before)
        r = range_of(mix(_spread(head_number[at]) + np.where(hot[at], _spread(number[word]), np.uint64(0))), ranges)
        order = np.lexsort((number[word], head_number[at], r))
        r, at = r[order], at[order]
        # Histories of each range, those without known followers too: their sums are needed.
        first = np.ones(len(r), bool)
        first[1:] = (r[1:] != r[:-1]) | (at[1:] != at[:-1])
        size = np.diff(np.append(np.flatnonzero(first), len(r)))
        bare = np.setdiff1d(np.flatnonzero(~hot), at)
        h_at, h_range, h_size = np.concatenate([at[first], bare]), np.concatenate([r[first], range_of(mix(_spread(head_number[bare])), ranges)]), np.concatenate([size, np.zeros(len(bare), np.int64)])
        by = np.lexsort((head_number[h_at], h_range))
        return Pairs(word[order], learned[order], r, order, which - skip, heads, head_number, hot, h_at[by], h_range[by], h_size[by])

    def ask_pairs(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        out: list[tuple[int, bytes, bytes]] = []
        if table.num_rows:
            t = BlockTokens(table)
            count, number, whole = told_words(t, info)
            p = pairs_of(t, count, number, whole)
            for (k, a, b), (c, d) in zip(*_both_cuts(p, ranges)):
                size = p.h_size[c:d]
                w = p.word[a:b]
                # Word numbers ascend within a history: steps are small.
                step = np.diff(number[w], prepend=0)
                first = (np.cumsum(size) - size)[size > 0]
                step[first] = number[w][first]
                at = p.h_at[c:d]
                out.append((k, pack(step, count[w], p.learned[a:b].astype(np.uint32)), pack(p.head_number[at], size.astype(np.uint32), p.hot[at].astype(np.uint8))))
        return pa.table({"range": pa.array([x[0] for x in out], pa.int32()), "block": pa.array([key[0].as_py()] * len(out), pa.int64()), "data": pa.array([x[1] for x in out], pa.binary()), "heads": pa.array([x[2] for x in out], pa.binary())})

    def tell_pairs(key: tuple, table: pa.Table) -> pa.Table:
        """Count of each asked bigram and sums of each history, to its block; the range's sums under block -1."""
        heads = [unpack(x, "i8", "u4", "u1") for x in table.column("heads").to_pylist()]
        pairs = [unpack(x, "i8", "i8", "u4") for x in table.column("data").to_pylist()]
        head = np.concatenate([np.repeat(h, n.astype(np.int64)) for h, n, _ in heads])
        word = np.concatenate([_undo(p[0], h[1].astype(np.int64)) for p, h in zip(pairs, heads)])
        c1, learned = np.concatenate([p[1] for p in pairs]), np.concatenate([p[2] for p in pairs]).astype(np.int64)
        order = np.lexsort((word, head))
        new = np.ones(len(head), bool)
        new[1:] = (head[order][1:] != head[order][:-1]) | (word[order][1:] != word[order][:-1])
        group = np.cumsum(new) - 1
        total = np.bincount(group, weights=learned[order]).astype(np.int64) if len(head) else np.zeros(0, np.int64)
        count = np.empty(len(head), np.int64)
        count[order] = total[group]
        one = order[new]
        own, where = np.unique(np.concatenate([h for h, _, _ in heads]), return_inverse=True)
        at, seen, c1 = np.searchsorted(own, head[one]), total > 0, c1[one]
        s = np.zeros((len(own), SUMS), np.int64)
        s[:, 0] = np.bincount(at, weights=total, minlength=len(own))
        s[:, 1] = np.bincount(at, weights=np.where(seen & (c1 > TOP), c1, 0), minlength=len(own))
        for r in range(1, TOP + 1):
            s[:, 1 + r] = np.bincount(at, weights=seen & (c1 == r), minlength=len(own))
            s[:, 1 + TOP + r] = np.bincount(at, weights=total == r, minlength=len(own))
        data = [pack(c.astype(np.uint32)) for c in np.split(count, np.cumsum([len(p[0]) for p in pairs])[:-1])]
        back = [pack(*s[k].T) for k in np.split(where, np.cumsum([len(h) for h, _, _ in heads])[:-1])]
        hot = np.unique(np.concatenate([h[f > 0] for h, _, f in heads]))
        times = np.bincount(np.minimum(total, TOP + 2), minlength=TOP + 3)[: TOP + 2].astype(np.int64)
        n = len(pairs)
        return pa.table(
            {
                "block": pa.array([*table.column("block").to_pylist(), -1], pa.int64()), "kind": pa.array([2] * n + [9], pa.int32()), "at": pa.array([key[0].as_py()] * (n + 1), pa.int64()),
                "data": pa.array([*data, pack(times)], pa.binary()), "heads": pa.array([*back, pack(hot, *s[np.searchsorted(own, hot)].T)], pa.binary()),
            }
        )

    sums = [f"s{k}" for k in range(SUMS)]

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A range's sums as rows: entry ``at`` of the data (``head`` false), or a history's sums."""
        for b in batches:
            for data, heads in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                one = unpack(data, "i8")[0]
                zeros = pa.array(np.zeros(len(one), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(one), bool)), pa.array(np.arange(len(one))), pa.array(one), *[zeros] * (SUMS - 1)], ["head", "at", *sums])
                if heads is not None:
                    at, *of = unpack(heads, *["i8"] * (1 + SUMS))
                    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), bool)), *(pa.array(x) for x in (at, *of))], ["head", "at", *sums])

    def closed(kind: int):
        """One row of all sums: an entry for each spread history, of which there are fewer than ranges."""

        def run(key: tuple, table: pa.Table) -> pa.Table:
            table = table.sort_by("at")
            data, heads = (table.filter(x) for x in (pc.invert(table["head"]), table["head"]))
            blob = pack(*(np.array(heads[x]) for x in ("at", *sums)))
            return pa.table({"kind": pa.array([kind], pa.int32()), "data": pa.array([pack(np.array(data["s0"]))], pa.binary()), "heads": pa.array([blob], pa.binary())})

        return run

    def to_all_blocks(told: DataFrame, kind: int) -> DataFrame:
        # Ranges are summed by an ordinary shuffle, history by history.
        rows = told.filter("block = -1").select("data", "heads").mapInArrow(opened, "head boolean, at long, " + ", ".join(f"{x} long" for x in sums))
        summed = rows.groupBy("head", "at").agg(*[F.sum(x).alias(x) for x in sums])
        whole = summed.groupBy(F.lit(-1).alias("all")).applyInArrow(closed(kind), "kind int, data binary, heads binary")
        return whole.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "kind", F.lit(0).cast("long").alias("at"), "data", "heads")

    def score(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(names, kinds)})
        t = BlockTokens(table)
        count, number, whole = told_words(t, info)
        p = pairs_of(t, count, number, whole)
        n, v = int(whole[TOP + 2]), int(whole[TOP + 3])
        d1, d2 = discounts(whole[: TOP + 2]), discounts(unpack(_one(info, 3, "data"), "i8")[0])
        small = np.arange(1, TOP + 1)
        # Words.
        left = float((whole[1 : TOP + 1] * small * (1 - d1[1 : TOP + 1])).sum()) / max(n, 1)
        even = 1.0 if left > 0 else n / (n + 1)
        left = left if left > 0 else 1 / (n + 1)
        c = count[t.word]
        p1 = np.where(c > 0, d1[np.minimum(c, TOP + 1)] * c / max(n, 1) * even, left)
        # Bigrams, as the ranges answer.
        c2, sums = np.zeros(len(p.word), np.int64), np.zeros((len(p.heads), SUMS), np.int64)
        by_range = {a: (d, h) for k, a, d, h in zip(*(info.column(x).to_pylist() for x in ("kind", "at", "data", "heads"))) if k == 2}
        for (k, a, b), (x, y) in zip(*_both_cuts(p, ranges)):
            c2[p.order[a:b]] = unpack(by_range[k][0], "u4")[0]
            sums[p.h_at[x:y]] = np.stack(unpack(by_range[k][1], *["i8"] * SUMS), 1)
        wide, *wide_sums = unpack(_one(info, 3, "heads"), *["i8"] * (1 + SUMS))
        hot = np.flatnonzero(p.hot)
        if len(hot):
            place = np.minimum(np.searchsorted(wide, p.head_number[hot]), max(len(wide) - 1, 0))
            there = wide[place] == p.head_number[hot] if len(wide) else np.zeros(len(hot), bool)
            sums[hot[there]] = np.stack(wide_sums, 1)[place[there]]
            sums[hot[~there]] = 0
        total = sums[:, 0]
        spare = (sums[:, 2 + TOP :] * small * (1 - d2[1 : TOP + 1])).sum(1) / np.maximum(total, 1)
        trim = np.where(spare > 0, 1.0, total / (total + 1))
        spare = np.where(spare > 0, spare, 1 / (total + 1))
        seen = (sums[:, 1] + (sums[:, 2 : 2 + TOP] * small * d1[1 : TOP + 1]).sum(1)) / max(n, 1) * even
        backoff = np.where(total > 0, spare / np.maximum(1 - seen, 1e-300), 1.0)
        head = np.minimum(np.searchsorted(p.heads, t.before), max(len(p.heads) - 1, 0))
        known = p.heads[head] == t.before if len(p.heads) else np.zeros(len(head), bool)
        pair = np.where(p.which >= 0, c2[p.which] if len(c2) else 0, 0)
        prob = np.where(known, backoff[head] if len(p.heads) else 1.0, 1.0) * p1
        hit = pair > 0
        prob[hit] = d2[np.minimum(pair[hit], TOP + 1)] * pair[hit] / total[head[hit]] * trim[head[hit]]
        base = np.log10((c + 0.1) / (n + 0.1 * (v + 1)))
        rows_ = len(t.counts)
        give_back()
        add = lambda x: np.bincount(t.row, weights=x, minlength=rows_)
        return pa.table(
            [t.table.column("doc_id").combine_chunks(), pa.array(t.train), pa.array(t.counts.astype(np.int64)), pa.array(add(c > 0).astype(np.int64)), pa.array([n] * rows_, pa.int64()), pa.array(add(base)), pa.array(add(np.log10(prob)))],
            names=names,
        )

    names = ["doc_id", "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
    words = by_block.applyInArrow(ask_words, "range int, block long, data binary").groupBy("range").applyInArrow(tell_words, form)
    about_words = words.filter("block >= 0").unionByName(to_all_blocks(words, 1))
    asked = by_block.cogroup(about_words.groupBy("block")).applyInArrow(ask_pairs, "range int, block long, data binary, heads binary")
    pairs = asked.groupBy("range").applyInArrow(tell_pairs, form)
    about = about_words.unionByName(pairs.filter("block >= 0")).unionByName(to_all_blocks(pairs, 3))
    return by_block.cogroup(about.groupBy("block")).applyInArrow(score, "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


@dataclass
class Pairs:
    """A block's distinct known bigrams in the order of the question, and their histories."""

    word: np.ndarray
    learned: np.ndarray
    range: np.ndarray
    order: np.ndarray
    #: Of each token: its bigram before ordering, or -1.
    which: np.ndarray
    #: Known histories (-1: the start), their numbers, and whether they are spread.
    heads: np.ndarray
    head_number: np.ndarray
    hot: np.ndarray
    #: Histories as the ranges are asked about them: which, at what range, with how many bigrams.
    h_at: np.ndarray
    h_range: np.ndarray
    h_size: np.ndarray


def _both_cuts(p: Pairs, ranges: int) -> tuple[list, list]:
    """For each range that is asked: (range, first, stop) of its bigrams, and (first, stop) of its histories."""
    a, b = (np.searchsorted(x, np.arange(ranges + 1)).tolist() for x in (p.range, p.h_range))
    there = [k for k in range(ranges) if b[k] < b[k + 1]]
    return [(k, a[k], a[k + 1]) for k in there], [(b[k], b[k + 1]) for k in there]


def _undo(steps: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Values from steps, where each group's first step is a value."""
    sizes = sizes[sizes > 0]
    done = np.cumsum(steps)
    first = np.cumsum(sizes) - sizes
    return done - np.repeat(done[first] - steps[first], sizes)


def _one(info: pa.Table, kind: int, column: str = "data") -> bytes:
    """The row of that kind; without one (no bigram was learned) what packs no entry."""
    found = info.filter(pc.equal(info.column("kind"), kind)).column(column)
    return found[0].as_py() if len(found) else pack(np.zeros(0, np.int64))
