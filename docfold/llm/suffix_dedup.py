"""Substring deduplication: long repeats are found by a suffix sort that compares by hashes.

Every string of ``length`` bytes that also starts earlier is a repeat, and the bytes it covers go.  A suffix is
compared over its first ``length`` bytes: prefix polynomial hashes and a binary search find the common
extension of two suffixes, a mergesort orders them with such comparisons, neighbours with a common extension
of ``length`` are equal, and equal ones are verified byte by byte.

Only suffixes that may have an equal are sorted.  Each window of ``length`` bytes picks an anchor (the gram in
it with the smallest hash), so equal windows pick equal anchors at equal places, and consecutive windows with
one anchor form a run.  Blocks of documents ask the hash ranges about their runs (anchor hash and hash of the
run's whole text): runs whose anchor occurs once are done, runs with the hash of an earlier run repeat it as a
whole, and what is left is sent by anchor to the tasks that sort.  Runs that were taken for equal go there too,
with the first of their kind, and their bytes are compared; those that differ are sorted after all.  Anchors
with very many different runs are spread over salted sorts, whose survivors meet once more by the hash of their
window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import pack, range_of, unpack, with_blocks
from .common import give_back, mix, powers, prefix_hashes, bounded_batches, span_hashes

GRAM = 32
#: Of an anchor's different runs in one block, so many are asked about; the others go to the sort.
ASKED = 16
#: An anchor with more different runs than this is sorted in salted parts.
HOT = 1000
#: States of runs; FIRST is added where later runs repeat one, AGAIN where a repeat's anchor is salted.
DONE, REPEAT, SORT, SALTED, FIRST, AGAIN = 0, 1, 2, 3, 64, 128
#: Places in a block's text; a row holds 2**31 bytes at most, and a block less than that before its last row.
_PLACE = np.uint64((1 << 34) - 1)


class Runs:
    """Runs of windows with one anchor in texts laid end to end: first and last start, anchor, hashes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int, bits: int = 64) -> None:
        self.data, self.length = data, length
        size = np.diff(offsets)
        begin = offsets[:-1][size >= length]
        stop = offsets[1:][size >= length] - length + 1
        none = np.zeros(0, np.int64)
        self.lo = self.hi = self.anchor = none
        self.gram = self.text = np.zeros(0, np.uint64)
        if not len(begin):
            return
        self.prefix = prefix_hashes(data)
        at = np.arange(len(data) - GRAM + 1)
        gram = mix(span_hashes(self.prefix, at, at + GRAM))
        # The smallest hash in reach of each start, its place in the low bits; ties go to the first.
        low = (gram & ~_PLACE) | at.astype(np.uint64)
        reach, have = length - GRAM + 1, 1
        while 2 * have <= reach:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if reach > have:
            low = np.minimum(low[: len(low) - (reach - have)], low[reach - have :])
        change = np.zeros(len(data) + 1, np.int8)
        change[begin] += 1
        change[stop] -= 1
        starts = np.flatnonzero(np.cumsum(change[:-1], dtype=np.int8))
        anchor = (low[starts] & _PLACE).astype(np.int64)
        first = np.ones(len(starts), bool)
        first[1:] = (anchor[1:] != anchor[:-1]) | (starts[1:] != starts[:-1] + 1)
        k = np.flatnonzero(first)
        self.lo, self.anchor = starts[k], anchor[k]
        self.hi = starts[np.append(k[1:], len(starts)) - 1]
        self.gram = gram[self.anchor]
        self.text = mix(span_hashes(self.prefix, self.lo, self.hi + length) + (self.anchor - self.lo).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)) & np.uint64((1 << bits) - 1)

    def differ(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the bytes of runs ``a`` and ``b``, or the places of their anchors, differ."""
        size = self.hi - self.lo + self.length
        out = (size[a] != size[b]) | (self.anchor[a] - self.lo[a] != self.anchor[b] - self.lo[b])
        left = np.flatnonzero(~out)
        done = np.cumsum(size[a[left]])
        for part in np.split(left, np.searchsorted(done, np.arange(1 << 20, int(done[-1]) if len(done) else 0, 1 << 20))):
            if len(part):
                n = size[a[part]]
                step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                unlike = self.data[np.repeat(self.lo[a[part]], n) + step] != self.data[np.repeat(self.lo[b[part]], n) + step]
                out[part] = np.add.reduceat(unlike, np.cumsum(n) - n) > 0
        return out


class BlockText:
    """One block's rows in the order of their ids, and its runs."""

    def __init__(self, table: pa.Table, length: int, bits: int = 64) -> None:
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        self.table = table
        text = table.column("text").cast(pa.large_binary()).combine_chunks()
        text = text if isinstance(text, pa.Array) else pa.concat_arrays(text.chunks)
        self.offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        body = text.buffers()[2]
        self.data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = self.data[self.offsets[0] : self.offsets[-1]]
        self.offsets = self.offsets - self.offsets[0]
        self.ids = np.array(table.column("doc_id").fill_null(-(1 << 63)).to_numpy())
        self.runs = Runs(self.data, self.offsets, length, bits)
        self.row = np.searchsorted(self.offsets, self.runs.lo, "right") - 1
        # The first run of each text, in order; later equal runs repeat it.
        _, own, kind = np.unique(self.runs.text, return_index=True, return_inverse=True)
        later = np.setdiff1d(np.arange(len(kind)), own)
        unlike = later[self.runs.differ(later, own[kind[later]])]
        if len(unlike):
            # Equal hashes of different texts: each of these gets a hash of its own, and bytes decide in the sort.
            self.runs.text[unlike] = mix(self.runs.text[unlike] + mix(unlike.astype(np.uint64) + np.uint64(1)))
            own = np.append(own, unlike)
        self.fresh = np.sort(own)
        self.repeats = np.ones(len(self.runs.lo), bool)
        self.repeats[self.fresh] = False

    def asked(self, ranges: int, most: int = ASKED) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the fresh runs: which are asked about (ordered by range, then text order), their ranges, how many
        more different runs their anchors have, and which runs aren't asked about."""
        gram = self.runs.gram[self.fresh]
        order = np.argsort(gram, kind="stable")
        g = gram[order]
        first = np.ones(len(g), bool)
        first[1:] = g[1:] != g[:-1]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(g)), 0))
        nth = np.arange(len(g)) - begin
        count = np.diff(np.append(np.flatnonzero(first), len(g)))
        over = np.maximum(np.repeat(count, count) - most, 0) if len(g) else count
        ask = np.sort(order[nth < most])
        more = np.zeros(len(g), np.int64)
        more[order] = np.where(nth == 0, over, 0)
        r = range_of(gram[ask], ranges)
        by_range = np.argsort(r, kind="stable")
        rest = np.setdiff1d(np.arange(len(g)), ask)
        return self.fresh[ask[by_range]], r[by_range], more[ask[by_range]], self.fresh[rest]


def answer(grams: np.ndarray, texts: np.ndarray, ids: np.ndarray, more: np.ndarray, blocks: np.ndarray, most: int = HOT) -> np.ndarray:
    """State of every asked run of one range: DONE, REPEAT, SORT, or SALTED + log2 of the number of salts.

    A repeat of an anchor with salts has both: runs of that anchor that weren't asked about need the salts.  The
    first of several runs of one hash has FIRST besides.
    """
    order = np.lexsort((blocks, ids, texts, grams))
    g, t = grams[order], texts[order]
    new_g, new_t = np.ones(len(g), bool), np.ones(len(g), bool)
    new_g[1:] = g[1:] != g[:-1]
    new_t[1:] = new_g[1:] | (t[1:] != t[:-1])
    group = np.cumsum(new_g) - 1
    kinds = np.bincount(group, weights=new_t).astype(np.int64) + np.bincount(group, weights=more[order]).astype(np.int64)
    over = np.bincount(group, weights=more[order]) > 0
    hot = over | (kinds > most)
    salts = np.clip(np.ceil(np.log2(np.maximum(kinds / (most / 2), 2))), 1, 40).astype(np.int64)
    state = np.where(kinds == 1, DONE, np.where(hot, SALTED + salts, SORT))[group]
    out = np.empty(len(g), np.uint8)
    kind = np.cumsum(new_t) - 1
    several = np.bincount(kind)[kind] > 1
    out[order] = np.where(new_t, state + FIRST * several, np.where(hot[group], AGAIN + state, REPEAT))
    return out


def common_extension(prefix: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """How many first bytes (``length`` at most) the suffixes at a and b share: binary search over hashes."""
    down = powers(len(prefix))[1]
    low, high = np.zeros(len(a), np.int64), np.full(len(a), length)
    pa_, pb_ = prefix[a], prefix[b]
    da, db = down[a], down[b]
    for _ in range(length.bit_length()):
        mid = (low + high + 1) // 2
        same = (prefix[a + mid] - pa_) * da == (prefix[b + mid] - pb_) * db
        low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
    return low


def suffix_mergesort(data: np.ndarray, prefix: np.ndarray, at: np.ndarray, bucket: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``at``, within ascending buckets, by their first ``length`` bytes; stable.

    Bottom-up mergesort of all buckets at once.  A merge finds each element's place in the run beside its own
    by binary search; each comparison takes the logarithm of ``length`` in hash probes.
    """
    n = len(at)
    order = np.argsort(bucket, kind="stable")
    b = bucket[order]
    first = np.ones(n, bool)
    first[1:] = b[1:] != b[:-1]
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.diff(np.append(np.flatnonzero(first), n))
    end = begin + np.repeat(size, size) if n else begin
    padded = np.append(data, np.uint8(0))
    width, most = 1, int(size.max()) if n else 0
    while width < most:
        place = np.arange(n)
        run = (place - begin) // width
        left = run % 2 == 0
        own = begin + run * width
        other = np.where(left, own + width, own - width)
        o_lo, o_hi = np.minimum(other, end), np.minimum(other + width, end)
        low, high = o_lo.copy(), o_hi.copy()
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            x, y = at[order[live]], at[order[mid]]
            ext = common_extension(prefix, x, y, length)
            full = ext == length
            # Right elements go after equal left ones.
            below = np.where(full, ~left[live], padded[y + np.where(full, 0, ext)] < padded[x + np.where(full, 0, ext)])
            low[live], high[live] = np.where(below, mid + 1, low[live]), np.where(below, high[live], mid)
            live = live[low[live] < high[live]]
        to = np.where(left, own, own - width) + (place - own) + (low - o_lo)
        fresh = np.empty_like(order)
        fresh[to] = order
        order = fresh
        width *= 2
    return order


def repeated_suffixes(data: np.ndarray, at: np.ndarray, bucket: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Marks the suffixes that equal one of lower rank in their bucket."""
    prefix = prefix_hashes(data)
    order = suffix_mergesort(data, prefix, at, bucket, length)
    out = np.zeros(len(at), bool)
    if len(at) < 2:
        return out
    near = bucket[order][1:] == bucket[order][:-1]
    same = np.zeros(len(order), bool)
    k = np.flatnonzero(near) + 1
    same[k] = common_extension(prefix, at[order[k]], at[order[k - 1]], length) == length
    head = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    r = rank[order]
    best = np.minimum.reduceat(r, head)[group]
    keeper = np.empty(len(head), np.int64)
    keeper[group[r == best]] = order[r == best]
    later = r != best
    mine, theirs = order[later], keeper[group[later]]
    # Equal hashes are verified by bytes; a class that fails is split by its bytes.
    span = np.arange(length)
    for lo in range(0, len(mine), 20_000):
        a, b = mine[lo : lo + 20_000], theirs[lo : lo + 20_000]
        fine = (data[at[a][:, None] + span] == data[at[b][:, None] + span]).all(1)
        out[a[fine]] = True
        for x in a[~fine].tolist():
            members = order[group == group[np.flatnonzero(order == x)[0]]].tolist()
            text = data[at[x] : at[x] + length].tobytes()
            out[x] = any(rank[m] < rank[x] and data[at[m] : at[m] + length].tobytes() == text for m in members)
    return out


_SECOND = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)


def _second_hash(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of each window that is independent of the first: other byte codes and another base."""
    out = np.zeros(len(starts), np.uint64)
    for j in range(length):
        out = out * np.uint64(0xF1357AEA2E62A9C5) + _SECOND[data[starts + j]]
    return mix(out)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, block_bytes: int = 2 << 20, range_bytes: int = 16 << 20, carry: tuple[str, ...] = (), asked_runs: int = ASKED, hot_runs: int = HOT, hash_bits: int = 64, as_text: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans`` (array of start, end: maximal removed byte runs), ``kept`` (binary), ``carried``.

    A byte goes if a string of ``length`` bytes that covers it also starts earlier: at a smaller id, or earlier in
    the same document.  Strings are judged on the input, don't cross rows, and may overlap.

    Ids are integers; null ids come first.  Null text counts as empty.  Rows that repeat an id come in an
    order that their texts fix (and their places in the input, if texts repeat too).  Rows shorter than ``length`` keep all bytes.  An empty table gives no rows; columns
    named in ``carry`` return in the struct ``carried``, others are ignored.  ``hash_bits`` is how much of a run's
    hash is used (few, in tests, make runs collide).  With ``as_text`` there is ``text`` instead of ``kept``: what
    the kept bytes spell, without what is left of characters that were cut.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows, _, ranges = with_blocks(docs, id_col, text_col, block_bytes, range_bytes, carry)
    carried = rows.schema["carried"].dataType
    # Fields that can't be null come back as fields that can.
    carried_arrow = to_arrow_type(spark.createDataFrame([], f"carried {carried.simpleString()}").schema["carried"].dataType)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block = BlockText(table, length, hash_bits)
        which, r, more, _ = block.asked(ranges, asked_runs)
        cut = np.searchsorted(r, np.arange(ranges + 1)).tolist()
        there = [k for k in range(ranges) if cut[k] < cut[k + 1]]
        ids = block.ids[block.row[which]]
        blobs = []
        for k in there:
            s = slice(cut[k], cut[k + 1])
            w = which[s]
            blobs.append(pack(block.runs.gram[w], block.runs.text[w], np.diff(ids[s], prepend=0), more[s].astype(np.uint32)))
        return pa.table({"range": pa.array(there, pa.int32()), "block": pa.array([key[0].as_py()] * len(there), pa.int64()), "data": pa.array(blobs, pa.binary())})

    def reply(key: tuple, table: pa.Table) -> pa.Table:
        parts = [unpack(x, "u8", "u8", "i8", "u4") for x in table.column("data").to_pylist()]
        sizes = np.cumsum([len(p[0]) for p in parts])[:-1]
        of_block = np.repeat(np.array(table.column("block")), [len(p[0]) for p in parts])
        state = answer(*(np.concatenate(x) for x in (*zip(*((p[0], p[1], np.cumsum(p[2]), p[3]) for p in parts)),)), of_block, most=hot_runs)
        n = len(parts)
        return pa.table({"block": table.column("block"), "kind": pa.array([0] * n, pa.int32()), "at": table.column("range").cast(pa.int64()), "n": pa.array([0] * n, pa.int64()), "data": pa.array([pack(x) for x in np.split(state, sizes)], pa.binary())})

    def states(block: BlockText, info: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """State of every run (runs that repeat one of their own block are REPEAT), log2 of its salts, and whether
        its bytes are to be compared with those of other blocks."""
        which, r, _, rest = block.asked(ranges, asked_runs)
        raw = np.full(len(block.runs.lo), REPEAT, np.uint8)
        given = {a: d for k, a, d in zip(*(info.column(c).to_pylist() for c in ("kind", "at", "data"))) if k == 0}
        for k in np.unique(r).tolist():
            if k not in given:
                raise RuntimeError("a hash range didn't answer a block")
            raw[which[r == k]] = unpack(given[k], "u1")[0]
        check = np.zeros(len(raw), bool)
        check[which] = (raw[which] == REPEAT) | (raw[which] >= FIRST)
        # Runs that weren't asked about go where their anchor's asked runs go.
        if len(rest):
            by_gram = np.argsort(block.runs.gram[which], kind="stable")
            g = block.runs.gram[which][by_gram]
            told = raw[which][by_gram]
            for x in rest.tolist():
                a, b = np.searchsorted(g, block.runs.gram[x]), np.searchsorted(g, block.runs.gram[x], "right")
                raw[x] = (told[a:b] % FIRST).max()
        state = raw % FIRST
        salts = np.maximum(state.astype(np.int64) - SALTED, 0)
        return np.where(raw >= AGAIN, REPEAT, state), salts, check

    def fragments(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        block = BlockText(table, length, hash_bits) if table.num_rows else None
        if block is None or not len(block.runs.lo):
            return pa.table({k: pa.array([], t) for k, t in fragment_types})
        runs = block.runs
        state, salts, check = states(block, info)
        # What is taken for a repeat, and what it repeats, goes along for a check.
        pick = np.flatnonzero((state >= SORT) | check)
        # Fresh runs of a hot anchor are salted by their text, so that equal ones stay together.
        salt = (runs.text[pick] & ((np.uint64(1) << salts[pick].astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        body = block.data.tobytes()
        text = [body[a : b + length] for a, b in zip(runs.lo[pick].tolist(), runs.hi[pick].tolist())]
        columns = (
            runs.gram[pick].view(np.int64), salt, runs.text[pick].view(np.int64), pa.array(state[pick] < SORT), pa.array(salts[pick] > 0), block.ids[block.row[pick]],
            np.full(len(pick), key[0].as_py()), runs.lo[pick], (runs.anchor - runs.lo)[pick], pa.array(text, pa.binary()),
        )
        return pa.table({k: pa.array(c, t) for (k, t), c in zip(fragment_types, columns)})

    fragment_types = [("gram", pa.int64()), ("salt", pa.int64()), ("kind", pa.int64()), ("check", pa.bool_()), ("hot", pa.bool_()), ("doc_id", pa.int64()), ("block", pa.int64()), ("lo", pa.int64()), ("back", pa.int64()), ("text", pa.binary())]

    def sorter(hot: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            total, last, first = 0, None, None
            for b in batches:
                b = b.filter(b.column("hot") if hot else pa.compute.invert(b.column("hot")))
                if not b.num_rows:
                    continue
                b, first, unlike = compared(b, first)
                if unlike.num_rows:
                    yield not_repeats(unlike)
                if not b.num_rows:
                    continue
                # A group is sorted as a whole: cut where the key changes.
                keys = np.stack([np.array(b.column("gram")), np.array(b.column("salt"))], 1)
                cut = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
                if last is not None and tuple(keys[0]) != last:
                    cut = np.insert(cut, 0, 0)
                last = tuple(keys[-1])
                if len(cut) and total + b.num_rows >= 8192:
                    end = int(cut[-1])
                    held.append(b.slice(0, end))
                    yield _sorted(held, length, ranges if hot else 0)
                    held, total = [], 0
                    b = b.slice(end)
                held.append(b)
                total += b.num_rows
            if held:
                yield _sorted(held, length, ranges if hot else 0)

        return run

    def rebuild(key: tuple, table: pa.Table, info: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({k: pa.array([], t) for k, t in zip(("doc_id", "n_bytes", "spans", left, "carried"), (pa.int64(), pa.int64(), spans_type, left_type, carried_arrow))})
        block = BlockText(table, length, hash_bits)
        state, _, _ = states(block, info)
        change = np.zeros(len(block.data) + 1, np.int64)
        again = state == REPEAT
        told = np.array(info.column("kind")) == 1
        at, n = np.array(info.column("at"))[told], np.array(info.column("n"))[told]
        # Of runs with the hash of another but other bytes, the sort has told which starts repeat.
        again &= ~np.isin(block.runs.lo, at[n < 0])
        at, n = at[n > 0], n[n > 0]
        np.add.at(change, block.runs.lo[again], 1)
        np.add.at(change, block.runs.hi[again] + length, -1)
        np.add.at(change, at, 1)
        np.add.at(change, at + n - 1 + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
        # Runs of removed bytes end at row ends.
        inner = block.offsets[1:-1]
        split = inner[(inner > 0) & (inner < len(gone))]
        split = split[gone[split] & gone[split - 1]]
        first = np.union1d(np.flatnonzero(edge == 1), split)
        stop = np.union1d(np.flatnonzero(edge == -1), split)
        row = np.searchsorted(block.offsets, first, "right") - 1
        spans, kept = [[] for _ in range(len(block.ids))], []
        for r, a, b in zip(row.tolist(), first.tolist(), stop.tolist()):
            spans[r].append({"start": a - int(block.offsets[r]), "end": b - int(block.offsets[r])})
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            one = block.data[a:b][~gone[a:b]].tobytes()
            kept.append(one.decode("utf-8", "ignore") if as_text else one)
        t = block.table
        give_back()
        return pa.table({"doc_id": t.column("doc_id"), "n_bytes": np.diff(block.offsets), "spans": pa.array(spans, spans_type), left: pa.array(kept, left_type), "carried": t.column("carried").cast(carried_arrow)})

    left, left_type = ("text", pa.string()) if as_text else ("kept", pa.binary())
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    form = "block long, kind int, at long, n long, data binary"
    by_block = rows.groupBy("block")
    asked = by_block.applyInArrow(ask, "range int, block long, data binary")
    replies = asked.groupBy("range").applyInArrow(reply, form)
    frags = by_block.cogroup(replies.groupBy("block")).applyInArrow(fragments, "gram long, salt long, kind long, check boolean, hot boolean, doc_id long, block long, lo long, back long, text binary")
    # Of one kind, what is sorted comes first, then what is compared with it, the smallest id before others.
    dealt = frags.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "kind", "check", "doc_id", "block", "lo")
    sorted_form = "block long, at long, n long, range int, data binary"
    marks = dealt.mapInArrow(sorter(False), sorted_form)
    hot = dealt.mapInArrow(sorter(True), sorted_form)
    later = hot.filter("data is not null").groupBy("range").applyInArrow(meet, "block long, at long, n long")
    found = [x.select("block", F.lit(1).alias("kind"), "at", "n", F.lit(None).cast("binary").alias("data")) for x in (marks, hot.filter("data is null"), later)]
    info = replies
    for x in found:
        info = info.unionByName(x)
    out = by_block.cogroup(info.groupBy("block")).applyInArrow(rebuild, f"doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, {left} {"string" if as_text else "binary"}, carried {carried.simpleString()}")
    return out if carry else out.drop("carried")


_KIND = ("gram", "salt", "kind", "back", "text")


def compared(b: pa.RecordBatch, first: pa.RecordBatch | None) -> tuple[pa.RecordBatch, pa.RecordBatch, pa.RecordBatch]:
    """What is to be sorted of a batch in order of kinds, the first row of its last kind, and the checked rows that
    differ from the first row of their kind.

    Rows to check leave if they equal that row; else both are sorted.  ``first`` is what the batch before gave.
    """
    rows = pa.Table.from_batches([b]) if first is None else pa.Table.from_batches([first, b])
    rows = rows.combine_chunks()
    kind = np.stack([np.array(rows.column(k)) for k in _KIND[:3]], 1)
    new = np.ones(len(kind), bool)
    new[1:] = (kind[1:] != kind[:-1]).any(1)
    place = np.maximum.accumulate(np.where(new, np.arange(len(kind)), 0))
    check = np.array(rows.column("check"))
    look = np.flatnonzero(check & ~new)
    theirs = rows.take(pa.array(place[look]))
    own = rows.take(pa.array(look))
    same = np.array(pa.compute.and_(pa.compute.equal(own.column("text"), theirs.column("text")), pa.compute.equal(own.column("back"), theirs.column("back"))), bool)
    keep = ~check
    unlike = look[~same]
    if len(unlike):
        keep[unlike] = True
        keep[place[unlike]] = True
    if first is not None:  # was given out before, unless it was one to check
        keep[0] &= bool(check[0])
    plain = lambda t: (t.to_batches() or [b.slice(0, 0)])[0]
    last = int(place[-1])
    nxt = plain(rows.slice(last, 1).combine_chunks())
    if keep[last] and check[last]:  # sorted already: it isn't given out again with the next batch
        nxt = nxt.set_column(nxt.schema.get_field_index("check"), "check", pa.array([False]))
    return plain(rows.filter(pa.array(keep)).combine_chunks()), nxt, plain(rows.take(pa.array(unlike)).combine_chunks())


def not_repeats(rows: pa.RecordBatch) -> pa.RecordBatch:
    n = rows.num_rows
    return pa.RecordBatch.from_arrays([rows.column("block"), rows.column("lo"), pa.array([-1] * n, pa.int64()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["block", "at", "n", "range", "data"])


def _sorted(held: list[pa.RecordBatch], length: int, ranges: int) -> pa.RecordBatch:
    """Repeats among whole groups of fragments, as runs of starts.

    With ``ranges`` (hot groups) also the starts that are left, packed by hash range.
    """
    t = pa.Table.from_batches(held).combine_chunks()
    gram, salt, doc, block, lo, back = (np.array(t.column(c)) for c in ("gram", "salt", "doc_id", "block", "lo", "back"))
    texts = t.column("text").to_pylist()
    size = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin = np.cumsum(size) - size
    n = size - length + 1
    frag = np.repeat(np.arange(len(n)), n)
    step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = begin[frag] + step
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (salt[1:] != salt[:-1])
    group = np.cumsum(new) - 1
    # Equal windows hold their anchor at the same place.
    bucket = group[frag] * length + back[frag] - step
    rank = np.empty(len(at), np.int64)
    rank[np.lexsort((lo[frag] + step, block[frag], doc[frag]))] = np.arange(len(at))
    again = repeated_suffixes(data, at, bucket, rank, length)
    first = again.copy()
    first[1:] &= ~(again[:-1] & (frag[1:] == frag[:-1]))
    last = again.copy()
    last[:-1] &= ~(again[1:] & (frag[1:] == frag[:-1]))
    a, b = np.flatnonzero(first), np.flatnonzero(last)
    f = frag[a]
    out = {"block": block[f], "at": lo[f] + step[a], "n": b - a + 1}
    rows = pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in out.items()} | {"range": pa.nulls(len(a), pa.int32()), "data": pa.nulls(len(a), pa.binary())})
    if not ranges:
        return rows
    k = np.flatnonzero(~again)
    h1 = span_hashes(prefix_hashes(data), at[k], at[k] + length)
    r = range_of(mix(h1), ranges)
    order = np.argsort(r, kind="stable")
    k, h1, r = k[order], h1[order], r[order]
    h2 = _second_hash(data, at[k], length)
    cut = np.searchsorted(r, np.arange(ranges + 1)).tolist()
    there = [x for x in range(ranges) if cut[x] < cut[x + 1]]
    f = frag[k]
    parts = (h1, h2, doc[f], block[f], lo[f] + step[k])
    none = pa.nulls(len(there), pa.int64())
    packed = pa.RecordBatch.from_arrays([none, none, none, pa.array(there, pa.int32()), pa.array([pack(*(x[cut[y] : cut[y + 1]] for x in parts)) for y in there], pa.binary())], rows.schema.names)
    return pa.Table.from_batches([rows, packed]).combine_chunks().to_batches()[0] if len(rows) + len(packed) else rows


def meet(key: tuple, table: pa.Table) -> pa.Table:
    """Starts of salted sorts that equal an earlier one of another salt, by two hashes of their windows."""
    h1, h2, doc, block, at = (np.concatenate(x) for x in zip(*(unpack(d, "u8", "u8", "i8", "i8", "i8") for d in table.column("data").to_pylist())))
    order = np.lexsort((at, block, doc, h2, h1))
    again = np.zeros(len(order), bool)
    again[1:] = (h1[order][1:] == h1[order][:-1]) & (h2[order][1:] == h2[order][:-1])
    k = order[again]
    return pa.table({"block": block[k], "at": at[k], "n": np.ones(len(k), np.int64)})


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100) -> DataFrame:
    """``docs`` with repeats removed from the text; all rows and columns stay.

    What is left of a character whose bytes are removed in part goes too.  A null text becomes empty.
    """
    others = tuple(c for c in docs.columns if c not in (id_col, text_col))
    cut = remove_repeats(docs, id_col, text_col, length, carry=others, as_text=True)
    from_ = {id_col: F.col("doc_id").cast(docs.schema[id_col].dataType), text_col: F.col("text")} | {c: F.col("carried")[c] for c in others}
    return cut.select(*[from_[c].alias(c) for c in docs.columns])
