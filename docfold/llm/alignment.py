"""Cross-tokenizer alignment: where tokens of two tokenizers end together, and how often their ids are linked."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import pack, unpack
from .common import bounded_batches, give_back, materialize
from .packing import byte_ranks

#: Tokenises a string (a blank and text): its ids.  With it come the bytes of each id.
Encode = Callable[[str], list[int]]

#: A blank after one of these always begins a new piece for both tokenizers, so texts can be cut there.
CUT = re.compile(r"(?<=[\w!-~])(?= )")
#: Ends of chunks that another may follow.
JOINT = re.compile(r"[\w!-~]\Z")
LONG_RUN = re.compile(r"\s{1000}")


# ---- tokenizers ----
def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for (printable ones for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(others)}


@functools.lru_cache(2)
def byte_level(path: str) -> tuple[Encode, list[bytes], bool]:
    """The tokenizer of a ``tokenizers`` file with byte-level BPE, each id's bytes, and whether texts may be cut at :data:`CUT`.

    Where the file's ids follow its merges, its vocabulary is used by rank, several times as fast and with the same ids.
    """
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before = spec.get("pre_tokenizer") or {}
    if before.get("type") != "ByteLevel":
        raise ValueError("a byte-level tokenizer is needed")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    library = lambda text: t.encode(text, add_special_tokens=False).ids
    plain = not spec.get("normalizer") and before.get("use_regex", True) and not before.get("add_prefix_space") and all(a["special"] for a in spec.get("added_tokens") or [])
    table = _byte_of_char()
    size = t.get_vocab_size()
    body = [bytes(table[c] for c in token) if all(c in table for c in token) else token.encode() for token in (t.id_to_token(i) or "" for i in range(size))]

    if not plain:
        return library, body, False
    try:
        ranks = byte_ranks(path)
    except ValueError:
        return library, body, True
    fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    # Matching the pattern on a long run of white space takes more stack than there is.
    return (lambda text: library(text) if LONG_RUN.search(text) else fast.encode_ordinary(text)), body, True


@functools.lru_cache(2)
def pieces(path: str) -> tuple[Encode, list[bytes], bool]:
    """The tokenizer of a ``sentencepiece`` model; the blank that it adds in front is part of the strings given here."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spec = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        spec.ParseFromString(f.read())
    n, rule = model.get_piece_size(), spec.normalizer_spec
    names = [model.id_to_piece(i) for i in range(n)]
    body = [bytes([int(p[3:5], 16)]) if model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
    # No token reaches over a blank that follows something else, and nothing is rewritten.
    plain = spec.trainer_spec.model_type == spec.trainer_spec.BPE and not rule.precompiled_charsmap and not rule.remove_extra_whitespaces and not any(re.search("[^▁]▁", p) for p in names)
    plain = plain and not any(p.type == p.USER_DEFINED for p in spec.pieces)

    return (lambda text: model.encode(text[1:])), body, bool(plain and rule.add_dummy_prefix and rule.escape_whitespaces)


# ---- alignment of one string ----
@dataclass
class Aligned:
    """Tokens of a string by both tokenizers, in groups that end at the ascending byte offsets ``ends``.

    ``to_a`` and ``to_b`` count the tokens up to each group's end.  ``text`` has each group as ``a1,a2|b1;`` and
    ``written`` its length up to each group's end.  ``links`` are pairs of ids as ``a << 32 | b``, and ``linked`` counts
    them up to each group's end.
    """

    ends: np.ndarray
    to_a: np.ndarray
    to_b: np.ndarray
    text: str
    written: np.ndarray
    links: np.ndarray
    linked: np.ndarray


class Vocabulary:
    """Each id's bytes, and the ways to write it: A's ids before a comma or a bar, B's before a comma or a semicolon."""

    def __init__(self, body_a: list[bytes], body_b: list[bytes]) -> None:
        self.a, self.b = body_a, body_b
        self.first_b = 2 * len(body_a)
        self.words = [f"{i}{end}" for n, ends in ((len(body_a), ",|"), (len(body_b), ",;")) for i in range(n) for end in ends]
        self.sizes = np.array([len(w) for w in self.words], np.int64)


def align(ids_a: list[int], ids_b: list[int], want: bytes, words: Vocabulary) -> Aligned | None:
    """Groups and links of two token lists; ``None`` where the bytes of either aren't ``want``.

    Each list's ends go to a dictionary from byte offset to the index after the token.  The offsets that are in both,
    in order, slice both id lists into groups; within a group the tokens that end at its end are linked.
    """
    bytes_a, bytes_b = [words.a[i] for i in ids_a], [words.b[i] for i in ids_b]
    if b"".join(bytes_a) != want or b"".join(bytes_b) != want:
        return None
    after_a = dict(zip(accumulate(map(len, bytes_a)), count(1)))
    after_b = dict(zip(accumulate(map(len, bytes_b)), count(1)))
    ends = sorted(after_a.keys() & after_b.keys())
    to_a, to_b = np.array([after_a[e] for e in ends], np.int64), np.array([after_b[e] for e in ends], np.int64)
    a, b = np.array(ids_a, np.int64), np.array(ids_b, np.int64)
    # A group's tokens of A are written before its tokens of B.
    code = np.empty(len(a) + len(b), np.int64)
    place_a = np.arange(len(a)) + np.repeat(to_b - np.diff(to_b, prepend=0), np.diff(to_a, prepend=0))
    place_b = np.arange(len(b)) + np.repeat(to_a, np.diff(to_b, prepend=0))
    code[place_a], code[place_b] = 2 * a, words.first_b + 2 * b
    code[place_a[to_a - 1]] += 1
    code[place_b[to_b - 1]] += 1
    text = "".join([words.words[c] for c in code.tolist()])
    written = np.cumsum(words.sizes[code])[to_a + to_b - 1]
    if all(bytes_a) and all(bytes_b):
        # One token of each ends where a group does.
        return Aligned(np.array(ends), to_a, to_b, text, written, a[to_a - 1] << 32 | b[to_b - 1], np.arange(1, len(ends) + 1))
    links, linked = [], []
    for i, m, j, n in zip([0, *to_a], to_a, [0, *to_b], to_b):
        links += [x << 32 | y for x in _last(ids_a, bytes_a, i, m) for y in _last(ids_b, bytes_b, j, n)]
        linked.append(len(links))
    return Aligned(np.array(ends), to_a, to_b, text, written, np.array(links, np.int64), np.array(linked))


def _last(ids: list[int], tokens: list[bytes], lo: int, hi: int) -> list[int]:
    """The tokens of a slice that end where it ends: the last one, and those before it while no bytes follow."""
    k = hi - 1
    while k > lo and not tokens[k]:
        k -= 1
    return ids[k:hi]


#: What a chunk holds: tokens of A, of B, groups, their text, links (64-bit numbers).
Chunk = tuple[int, int, int, str, bytes]


class Aligner:
    """Aligns texts by their chunks, each distinct chunk once while it is remembered."""

    def __init__(self, a: tuple[Encode, list[bytes], bool], b: tuple[Encode, list[bytes], bool], remember: int = 200_000) -> None:
        (self.a, body_a, cut_a), (self.b, body_b, cut_b) = a, b
        self.words = Vocabulary(body_a, body_b)
        self.cut, self.remember = cut_a and cut_b, remember
        self.known: dict[str, Chunk] = {}
        self.bad: set[str] = set()

    def chunks(self, text: str) -> list[str]:
        return CUT.split(" " + text) if self.cut else [" " + text]

    def learn(self, chunks: list[str]) -> None:
        """Aligns what isn't known yet, laid end to end as one string where each chunk may be followed by another."""
        if len(self.known) + len(self.bad) > self.remember:
            self.known.clear()
            self.bad.clear()
        new = [c for c in dict.fromkeys(chunks) if c not in self.known and c not in self.bad]
        joint = [c for c in new if self.cut and JOINT.search(c)]
        self._share(joint)
        for c in new:
            if c not in self.known and not self._share([c]):
                self.bad.add(c)

    def _share(self, chunks: list[str]) -> bool:
        """Aligns the chunks as one string, and deals its groups out; false if its tokens don't give its bytes."""
        if not chunks:
            return True
        whole = "".join(chunks)
        found = align(self.a(whole), self.b(whole), whole.encode("utf-8", "replace"), self.words)
        if found is None:
            return False
        # The end of each chunk is a common end, as texts may be cut there.
        last = np.searchsorted(found.ends, np.cumsum([len(c.encode("utf-8", "replace")) for c in chunks]))
        g, a, b, w, n = ([0, *x[last].tolist()] for x in (np.arange(1, len(found.ends) + 1), found.to_a, found.to_b, found.written, 8 * found.linked))
        links = found.links.tobytes()
        self.known.update((c, (a[k + 1] - a[k], b[k + 1] - b[k], g[k + 1] - g[k], found.text[w[k] : w[k + 1] - 1], links[n[k] : n[k + 1]])) for k, c in enumerate(chunks))
        return True

    def texts(self, texts: list[str | None]) -> list[list[str]]:
        """The chunks of each text, all known now; a text that can't be aligned has none."""
        cut = [self.chunks(t) if t else [] for t in texts]
        self.learn([c for each in cut for c in each])
        if self.bad:
            for i, each in enumerate(cut):
                if len(each) > 1 and not self.bad.isdisjoint(each):
                    # Whether the whole differs is for the whole to say.
                    cut[i] = [" " + texts[i]]
                    if cut[i][0] not in self.known and not self._share(cut[i]):
                        self.bad.add(cut[i][0])
        return [[] if self.bad and not self.bad.isdisjoint(each) else each for each in cut]


# ---- blocks ----
@dataclass
class Block:
    """Documents of one task whose texts have some bytes: chunk numbers in order, and what each distinct chunk holds."""

    ids: list = field(default_factory=list)
    sizes: list = field(default_factory=list)
    codes: list = field(default_factory=list)
    number: dict[str, int] = field(default_factory=dict)
    held: list[Chunk] = field(default_factory=list)
    bytes: int = 0

    def add(self, doc_id: int | None, chunks: list[str], known: dict[str, Chunk]) -> None:
        number = self.number
        for c in dict.fromkeys(chunks):
            if c not in number:
                number[c] = len(self.held)
                self.held.append(known[c])
        self.ids.append(doc_id)
        self.sizes.append(len(chunks))
        self.codes.append(np.fromiter(map(number.__getitem__, chunks), np.uint32, len(chunks)))
        self.bytes += sum(map(len, chunks)) + 64

    def row(self, name: str) -> pa.RecordBatch:
        codes = np.concatenate(self.codes) if self.codes else np.zeros(0, np.uint32)
        times = np.bincount(codes, minlength=len(self.held)).astype(np.int64)
        links = np.frombuffer(b"".join([c[4] for c in self.held]), np.int64)
        n_links = np.array([len(c[4]) // 8 for c in self.held], np.uint32)
        pairs, which = np.unique(links, return_inverse=True)
        seen = np.bincount(which, np.repeat(times, n_links), len(pairs)).astype(np.int64)
        docs = pack(np.array([x if x is not None else 0 for x in self.ids], np.int64), np.array([x is None for x in self.ids], np.uint8), np.array(self.sizes, np.uint32))
        held = pack(*[np.array([c[k] for c in self.held], np.uint32) for k in range(3)], n_links)
        fields = [[name], [docs], [pack(codes)], [held], [pack(which.astype(np.uint32))], [zstandard.ZstdCompressor(3).compress("\n".join([c[3] for c in self.held]).encode())], [pairs], [seen]]
        types = [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(fields, types)], BLOCK.names)


class BLOCK:
    names = ["block", "docs", "codes", "chunks", "links", "groups", "pairs", "seen"]
    schema = "block string, docs binary, codes binary, chunks binary, links binary, groups binary, pairs array<long>, seen array<long>"


def _blocks(docs: DataFrame, id_col: str, text_col: str, path_a: str, path_b: str, block_bytes: int) -> DataFrame:
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(byte_level(path_a), pieces(path_b))
        part, number, now = TaskContext.get().partitionId(), 0, Block()
        for b in batches:
            texts = b.column("text").to_pylist()
            for doc_id, text, chunks in zip(b.column("doc_id").to_pylist(), texts, aligner.texts(texts)):
                now.add(doc_id, chunks, aligner.known)
                if now.bytes >= block_bytes:
                    yield now.row(f"{part}-{number}")
                    number, now = number + 1, Block()
                    give_back()
        if now.ids:
            yield now.row(f"{part}-{number}")
        del aligner, now
        give_back()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, BLOCK.schema)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """One row per input row: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups``.

    A blank and the text are encoded by a byte-level BPE file (A) and a ``sentencepiece`` model (B), without special
    tokens.  Byte offsets where tokens of both end cut them into groups; ``groups`` lists these as ``a1,a2|b1;a3|b2,b3``.
    Tokens that end together are linked.  An id pair's count is the number of links of all documents between both ids;
    ``n_best`` are the document's links whose count is the highest of their B id, ties included, and ``count_sum`` adds
    the counts of its links.

    Tasks put whole documents into blocks of about ``block_bytes``, align each distinct chunk between blanks once
    (texts are cut where neither tokenizer can reach over, else taken whole), and keep chunk numbers by document and
    the block's distinct pairs.  Pairs are summed over blocks, and the highest of each B id is found, by shuffles of one
    row per block and distinct pair; blocks get the counts of their own pairs back.  No table of all pairs is broadcast
    or held by a task.

    Null and empty texts, and those whose tokens don't give back the bytes (A or B may not know a character), have
    zeros and ``groups`` ''.  Repeated rows and null ids count and come back like any other.  An empty table gives no
    rows.  Other columns are ignored, whatever their names.
    """
    blocks = materialize(_blocks(docs, id_col, text_col, path_a, path_b, block_bytes))
    asked = blocks.select(F.col("block").alias("of"), F.explode(F.arrays_zip("pairs", "seen")).alias("p")).select("of", F.col("p.pairs").alias("pair"), F.col("p.seen").alias("seen"))
    counts = asked.groupBy("pair").agg(F.sum("seen").alias("count"))
    # At most one row for each id of A and B's id.
    of_b = Window.partitionBy(F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)))
    judged = counts.select("pair", "count", (F.col("count") == F.max("count").over(of_b)).alias("best"))
    told = asked.select("of", "pair").join(judged, "pair")

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = np.asarray(right["pair"].combine_chunks())
        order = np.argsort(pairs)
        count, best = np.asarray(right["count"].combine_chunks())[order], np.asarray(right["best"].combine_chunks().cast(pa.uint8()))[order].astype(np.int64)
        out = []
        for r in left.to_pylist():
            ids, null, sizes = unpack(r["docs"], "<i8", "u1", "<u4")
            (codes,) = unpack(r["codes"], "<u4")
            n_a, n_b, n_groups, n_links = (x.astype(np.int64) for x in unpack(r["chunks"], "<u4", "<u4", "<u4", "<u4"))
            (which,) = unpack(r["links"], "<u4")
            chunk = np.repeat(np.arange(len(n_links)), n_links)
            sums = [_by(chunk, count[which], len(n_links)), _by(chunk, best[which], len(n_links))]
            begin = np.concatenate([[0], np.cumsum(sizes.astype(np.int64))])
            total = {name: _runs(values[codes], begin) for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups), ("n_links", n_links), ("n_best", sums[1]), ("count_sum", sums[0]))}
            text = zstandard.ZstdDecompressor().decompress(r["groups"]).decode().split("\n")
            groups = [";".join([text[k] for k in codes[lo:hi].tolist()]) for lo, hi in zip(begin[:-1].tolist(), begin[1:].tolist())]
            out.append(pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), **{k: pa.array(v) for k, v in total.items()}, "groups": pa.array(groups, pa.string())}))
        del left, right
        give_back()
        return pa.concat_tables(out) if out else pa.table({f.name: pa.array([], f.type) for f in _DONE})

    each = blocks.drop("pairs", "seen").groupBy("block").cogroup(told.groupBy("of"))
    return each.applyInArrow(finish, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")


_DONE = pa.schema([*[(n, pa.int64()) for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")], ("groups", pa.string())])


def _by(key: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of whole numbers by key (ascending)."""
    return _runs(values, np.searchsorted(key, np.arange(n + 1)))


def _runs(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of ``values[begin[i]:begin[i+1]]``, in 64-bit whole numbers."""
    total = np.concatenate([[0], np.cumsum(values.astype(np.int64))])
    return total[begin[1:]] - total[begin[:-1]]
