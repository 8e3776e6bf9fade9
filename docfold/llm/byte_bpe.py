"""Byte-level BPE over a whole corpus: every distinct piece is encoded once per word range, ids are joined back.

Texts are cut into blocks inside tasks.  A block lists its distinct pieces by word range and keeps each
document as a series of piece numbers (the positions).  The lists are shuffled by word range, where each
distinct piece is encoded once; the ids go back to their block, join the documents there, and are put in order
by position.  Decoding joins ids with the token-byte table, whose size is the vocabulary's.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, repeatable
from .pretokens import split_texts

HEAD, WORDS, DOC = 0, 1, 2


def load_ranks(rank_file: str) -> dict[bytes, int]:
    with open(rank_file, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) }


def squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32, byte planes apart so that they compress well."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(planes).tobytes())


def unsqueeze(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1)


def pack_words(words: list[bytes]) -> bytes:
    sizes = squeeze(np.array([len(w) for w in words], np.uint32))
    return len(sizes).to_bytes(4, "little") + sizes + zstandard.ZstdCompressor(1).compress(b"".join(words))


def unpack_words(blob: bytes) -> list[bytes]:
    n = int.from_bytes(blob[:4], "little")
    cut = np.concatenate([[0], np.cumsum(unsqueeze(blob[4 : 4 + n]).astype(np.int64))]).tolist()
    body = zstandard.ZstdDecompressor().decompress(blob[4 + n :])
    return [body[a:b] for a, b in zip(cut, cut[1:])]


class Block:
    """Rows of one task that are handled together; its number is a hash of what it holds."""

    def __init__(self, ids: list, texts: list[str], ranges: int) -> None:
        split = split_texts(texts)
        order = np.argsort(-np.bincount(split.which, minlength=len(split.distinct)), kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        #: Distinct pieces, most frequent first, the word range of each, and each row's piece numbers.
        self.words = [split.distinct[k].encode() for k in order.tolist()]
        self.range_of = np.array([zlib.crc32(w) % ranges for w in self.words], np.int64)
        self.numbers = np.split(rank[split.which], np.cumsum(split.counts)[:-1])
        self.ids = ids
        h = hashlib.blake2b(repr(ids).encode(), digest_size=8)
        for t in texts:
            h.update(t.encode() + b"\0")
        self.number = int.from_bytes(h.digest(), "little", signed=True)


def blocks(batches: Iterator[pa.RecordBatch], ranges: int, block_bytes: int) -> Iterator[Block]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            # Empty texts take room too.
            ids.append(i)
            texts.append(t or "")
            size += len(texts[-1]) + 64
            if size >= block_bytes:
                yield Block(ids, texts, ranges)
                ids, texts, size = [], [], 0
    if ids:
        yield Block(ids, texts, ranges)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 4 << 20) -> DataFrame:
    """``doc_id, ids`` (array of int) for each row, over its whole text, as the ``tiktoken`` library encodes it.

    ``rank_file`` must be readable by the executors.  Null and empty texts get an empty array; repeated rows are
    each encoded; null ids are kept; an empty table gives no rows; other columns are ignored.  A piece is
    encoded as often as a task's cache of 400,000 pieces overflows, else once.  Blocks are cut from the rows twice, so
    rows that don't come straight from files are written once first.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = repeatable(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    # Several ranges per partition even out what partitions get.
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = 4 * partitions

    def word_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ranges, block_bytes):
            order = np.argsort(block.range_of, kind="stable")
            cut = np.searchsorted(block.range_of[order], np.arange(ranges + 1)).tolist()
            there = [r for r in range(ranges) if cut[r] < cut[r + 1]]
            yield pa.RecordBatch.from_pydict(
                {"range": pa.array(there, pa.int32()), "block": pa.array([block.number] * len(there), pa.int64()), "words": pa.array([pack_words([block.words[k] for k in order[cut[r] : cut[r + 1]]]) for r in there], pa.binary())}
            )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        bpe = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=load_ranks(rank_file), special_tokens={})
        known: dict[bytes, list[int]] = {}
        for b in batches:
            out = []
            for blob in b.column("words").to_pylist():
                words = unpack_words(blob)
                if len(known) > 400_000:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = bpe.encode_ordinary(w.decode())
                found = [known[w] for w in words]
                sizes = squeeze(np.array([len(x) for x in found], np.uint32))
                out.append(len(sizes).to_bytes(4, "little") + sizes + squeeze(np.array([i for x in found for i in x], np.uint32)))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array([WORDS] * n, pa.int32()), b.column("range"), pa.nulls(n, id_arrow), pa.array(out, pa.binary())], ["block", "kind", "at", "doc_id", "data"])

    def positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, ranges, block_bytes):
            n = len(block.ids)
            kind = [HEAD] + [DOC] * n
            data = [squeeze(block.range_of)] + [squeeze(x) for x in block.numbers]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.number] * (n + 1), pa.int64()), pa.array(kind, pa.int32()), pa.array([-1, *range(n)], pa.int32()), pa.array([None, *block.ids], id_arrow), pa.array(data, pa.binary())],
                ["block", "kind", "at", "doc_id", "data"],
            )

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = None
        for b in batches:
            out_ids, out = [], []
            for number, kind, at, doc, data in zip(*(b.column(k).to_pylist() for k in range(5))):
                if kind == HEAD:
                    block, range_of, given, table = number, unsqueeze(data).astype(np.int64), {}, None
                elif kind == WORDS:
                    n = int.from_bytes(data[:4], "little")
                    given[at] = (unsqueeze(data[4 : 4 + n]).astype(np.int64), unsqueeze(data[4 + n :]).astype(np.int32))
                else:
                    if block != number:
                        raise RuntimeError("a block of documents has no word list")
                    if table is None:
                        table = _table(range_of, given)
                    begin, size, flat = table
                    k = unsqueeze(data).astype(np.int64)
                    n = size[k]
                    skip = begin[k] - (np.cumsum(n) - n)
                    out.append(flat[np.repeat(skip, n) + np.arange(int(n.sum()))])
                    out_ids.append(doc)
            if out_ids:
                cut = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in out])]), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(out_ids, id_arrow), pa.ListArray.from_arrays(cut, pa.array(np.concatenate(out), pa.int32()))], ["doc_id", "ids"])

    from pyspark.sql.pandas.types import to_arrow_type

    id_arrow = to_arrow_type(rows.schema["doc_id"].dataType)
    form = f"block long, kind int, at int, doc_id {id_type}, data binary"
    words = rows.mapInArrow(word_lists, "range int, block long, words binary")
    encoded = words.repartition(partitions, "range").mapInArrow(encode, form)
    joined = rows.mapInArrow(positions, form).unionByName(encoded)
    return joined.repartition("block").sortWithinPartitions("block", "kind", "at").mapInArrow(reassemble, f"doc_id {id_type}, ids array<int>")


def _table(range_of: np.ndarray, given: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each piece's ids begin, how many there are, and the ids of all; pieces by number."""
    begin, size, flat, base = np.zeros(len(range_of), np.int64), np.zeros(len(range_of), np.int64), [np.zeros(0, np.int32)], 0
    for r in np.unique(range_of).tolist():
        if r not in given:
            raise RuntimeError("a word range didn't answer a block of documents")
        n, ids = given[r]
        mine = np.flatnonzero(range_of == r)
        size[mine] = n
        begin[mine] = base + np.cumsum(n) - n
        flat.append(ids)
        base += len(ids)
    return begin, size, np.concatenate(flat)


def decode_documents(encoded: DataFrame, rank_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, ids, decoded`` (binary): each id joined with the broadcast token-byte table, bytes in order.

    The table has one row per vocabulary entry.  Null arrays decode to nothing; an unknown id raises.
    """
    spark = encoded.sparkSession
    bounded_batches(spark)
    by_id = sorted((i, t) for t, i in load_ranks(rank_file).items())
    shared = spark.sparkContext.broadcast({i: t for i, t in by_id})
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = max(shared.value, default=-1)
        sizes = np.zeros(top + 2, np.int64)
        for i, t in shared.value.items():
            sizes[i] = len(t)
        begin = np.concatenate([[0], np.cumsum(sizes)])
        flat = np.frombuffer(b"".join(shared.value.get(i, b"") for i in range(top + 1)), np.uint8)
        for b in batches:
            column = b.column(1)
            out = []
            for k in range(b.num_rows):
                ids = column[k].values
                ids = np.asarray(ids, np.int64) if ids is not None else np.zeros(0, np.int64)
                n = sizes[ids] if not len(ids) or 0 <= ids.min() and ids.max() <= top else np.zeros(1, np.int64)
                if len(ids) and not n.all():
                    raise ValueError("an id is not in the token-byte table")
                out.append(flat[np.repeat(begin[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), column, pa.array(out, pa.binary())], ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids array<int>, decoded binary")
