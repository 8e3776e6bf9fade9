"""Packing: documents in order into training sequences, by dynamic programming over the window cuts.

A window may end after a document, after a sentence, or (rarely, within long runs without sentence ends) at
regular places.  Cuts cost what they truncate, windows cost their padding, and the cheapest series of cuts is
found with a monotone queue: padding is linear in a window's start, so the best start in reach is the front
of the queue.  Windows whose length is a power of two need no padding and are tried besides.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_steps
from .pretokens import split_texts


@dataclass(frozen=True)
class PackingRule:
    """Window size, what each kind of cut costs (in tokens of padding), and how far apart plain cuts lie."""

    size: int = 1024
    sentence_cost: int = 4
    plain_cost: int = 24
    plain_step: int = 64
    window_cost: int = 1
    group_tokens: int = 1 << 20


def choose_cuts(places: np.ndarray, costs: np.ndarray, rule: PackingRule) -> list[int]:
    """Positions of the cheapest windows' ends.

    places: ascending candidate positions from 0 to the end, no two further apart than a window; costs: of a
    cut at each.  The cost of a window is its padding plus ``window_cost``.
    """
    size, n = rule.size, len(places)
    pos, pen = places.tolist(), costs.tolist()
    best, origin = [0] * n, [0] * n
    index = {p: i for i, p in enumerate(pos)}
    # Tiny windows aren't tried: each window has its cost.
    exact = [1 << b for b in range(size.bit_length()) if size // 128 < 1 << b < size]
    queue = deque([(0, 0)])  # (cost + position, candidate), costs ascending
    seek = index.get
    for i in range(1, n):
        p = pos[i]
        while pos[queue[0][1]] < p - size:
            queue.popleft()
        front, j = queue[0]
        low = front + size - p
        for length in exact:
            k = seek(p - length)
            if k is not None and best[k] < low:
                low, j = best[k], k
        best[i], origin[i] = low + pen[i] + rule.window_cost, j
        g = best[i] + p
        while queue and queue[-1][0] >= g:
            queue.pop()
        queue.append((g, i))
    out, i = [], n - 1
    while i:
        out.append(pos[i])
        i = origin[i]
    return out[::-1]


def cut_places(doc_ends: np.ndarray, sentence_ends: np.ndarray, rule: PackingRule) -> tuple[np.ndarray, np.ndarray]:
    """All candidates and their costs: document ends, sentence ends, and plain cuts in what is left over."""
    places = np.unique(np.concatenate([[0], doc_ends, sentence_ends]))
    gap = np.diff(places)
    wide = np.flatnonzero(gap > 2 * rule.plain_step)
    plain = [np.arange(places[k] + rule.plain_step, places[k + 1], rule.plain_step) for k in wide]
    every = np.unique(np.concatenate([places, *plain]))
    costs = np.full(len(every), rule.plain_cost)
    costs[np.searchsorted(every, sentence_ends)] = rule.sentence_cost
    costs[np.searchsorted(every, doc_ends)] = 0
    costs[0] = 0
    return every, costs


def byte_ranks(tokenizer_file: str) -> dict[bytes, int]:
    """Token bytes and ids of a ``tokenizers`` file of byte-level BPE whose ids follow the order of its merges."""
    with open(tokenizer_file, encoding="utf-8") as f:
        model = json.load(f)["model"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(map(chr, plain), plain)) | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    merged = [x if isinstance(x, str) else "".join(x) for x in model["merges"]]
    order = [model["vocab"][x.replace(" ", "")] for x in merged]
    if order != sorted(order):
        raise ValueError("ids don't follow the merges")
    return {bytes(shown[c] for c in token): i for token, i in model["vocab"].items() if all(c in shown for c in token) and (len(token) == 1 or i >= order[0]) and i <= order[-1]}


def added_tokens(tokenizer_file: str) -> dict[str, bytes]:
    """Literals that the file matches in texts before any splitting, and the id of each as little-endian 32-bit bytes."""
    with open(tokenizer_file, encoding="utf-8") as f:
        file = json.load(f)
    added = file.get("added_tokens") or []
    if file.get("normalizer") or any(x.get(k) for x in added for k in ("single_word", "lstrip", "rstrip")):
        raise ValueError("texts are normalised, or added tokens match more or less than their literals")
    return {x["content"]: struct.pack("<I", x["id"]) for x in added if x["content"]}


class PieceEncoder:
    """Token ids of pieces as little-endian 32-bit bytes; each distinct piece is encoded once while cached."""

    def __init__(self, tokenizer_file: str, limit: int = 100_000) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        self.bpe = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=byte_ranks(tokenizer_file), special_tokens={})
        self.added = added_tokens(tokenizer_file)
        # The longest of the literals that begin at one place matches.
        self.literals = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.cache: dict[str, bytes] = {}
        self.limit = limit

    def encode(self, pieces: list[str]) -> list[bytes]:
        if len(self.cache) > self.limit:
            self.cache.clear()
        for p in pieces:
            if p not in self.cache:
                ids = self.bpe.encode_ordinary(p)
                self.cache[p] = struct.pack(f"<{len(ids)}I", *ids)
        return [self.cache[p] for p in pieces]

    def cut(self, text: str) -> list[str]:
        """The text's parts; each second one is an added token."""
        return self.literals.split(text) if any(x in text for x in self.added) else [text]


@functools.lru_cache(1)
def piece_encoder(tokenizer_file: str) -> PieceEncoder:
    """One per Python worker, so that tasks share what is cached."""
    return PieceEncoder(tokenizer_file)


_ENDS = np.array([ord(c) for c in ".!?\n"], np.uint32)


def encode_step(texts: list[str], encoder: PieceEncoder, end_id: int) -> Iterator[tuple[bytes, np.ndarray]]:
    """Of each text: its ids with the end id, as bytes, and the token positions after which a sentence ends."""
    cuts = [encoder.cut(t) for t in texts]
    split = split_texts([x for parts in cuts for x in parts[::2]])
    ids = encoder.encode(split.distinct)
    flat = np.frombuffer(b"".join(ids), "<u4")
    size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
    n = size[split.which]
    done = np.cumsum(n)
    tokens = flat[np.repeat((np.cumsum(size) - size)[split.which] - done + n, n) + np.arange(int(n.sum()))]
    closes = np.isin(split.last, _ENDS)
    end = np.array([end_id], "<u4").tobytes()
    counts = iter(split.counts.tolist())
    piece = token = 0
    for parts in cuts:
        out, ends, at = [], [], 0
        for added in [*parts[1::2], None]:
            count = next(counts)
            stop = int(done[piece + count - 1]) if count else token
            out += tokens[token:stop].tobytes(), end if added is None else encoder.added[added]
            ends.append(done[piece : piece + count][closes[piece : piece + count]] - token + at)
            at += stop - token + 1
            piece, token = piece + count, stop
        yield b"".join(out), ends[0] if len(ends) == 1 else np.concatenate(ends)


def pack_documents(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, rule: PackingRule = PackingRule()) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    Documents are laid end to end in the order of their ids, whole texts, each closed by ``end_id``; each
    token lies in exactly one piece and sequences hold at most ``rule.size`` tokens.  Windows don't cross the
    ranges of ids that tasks get, nor groups of ``rule.group_tokens``, so at most one short sequence in each
    isn't chosen by cost.  ``tokenizer_file`` is a ``tokenizers`` file of byte-level BPE, readable by executors.

    Null text counts as empty and gives the end id alone.  Repeated rows are packed as often as they occur
    (in the order of a hash of their texts, which lets one id take several tasks); null ids come first.  An empty table gives no rows.  Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = piece_encoder(tokenizer_file)
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[object, bytes, np.ndarray]] = []
        tokens = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence, held, tokens
            size = np.array([len(b) // 4 for _, b, _ in held])
            doc_ends = np.cumsum(size)
            begin = doc_ends - size
            sentences = np.concatenate([s + o for (_, _, s), o in zip(held, begin)])
            ends = choose_cuts(*cut_places(doc_ends, sentences, rule), rule)
            out = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
            d, lo = 0, 0
            for hi in ends:
                at = lo
                while at < hi:
                    stop = min(hi, int(doc_ends[d]))
                    key, ids, _ = held[d]
                    s = at - int(begin[d])
                    n = stop - at
                    for name, x in zip(out, (key, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), int(size[d]), sequence, at - lo)):
                        out[name].append(x)
                    at = stop
                    d += stop == doc_ends[d]
                sequence += 1
                lo = hi
            held, tokens = [], 0
            return pa.RecordBatch.from_arrays([pa.array(out["doc_id"], key_type), *(pa.array(out[k], pa.int64()) for k in list(out)[1:])], list(out))

        key_type = None
        for b in batches:
            key_type = b.schema.field(0).type
            for lo, hi, _, _ in text_steps(b.column(1)):
                keys = b.column(0).slice(lo, hi - lo).to_pylist()
                for key, (ids, sentences) in zip(keys, encode_step(b.column(1).slice(lo, hi - lo).to_pylist(), encoder, end_id)):
                    held.append((key, ids, sentences))
                    tokens += len(ids) // 4
                    if tokens >= rule.group_tokens:
                        yield flush()
        if held:
            yield flush()

    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(partitions, *by).sortWithinPartitions(*by, "text")
    return ordered.mapInArrow(run, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
