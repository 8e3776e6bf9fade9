"""Helpers shared by the operators: durable intermediate tables and vectorised byte work inside tasks."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.batches import BATCH_BYTES, BATCH_ROWS, bounded_batches  # noqa: F401

#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``.

    Where that is unset a temporary folder is set if the session runs on one machine, as in tests; else it raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def materialize(df: DataFrame) -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back, so lost executors cost no rework.

    The tasks that compute it write it: there are as many files as they are, which AQE decides by size after a shuffle.
    """
    path = f"{shared_dir(df.sparkSession)}/{df.sparkSession.sparkContext.applicationId}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What leaves rows in the order of their files, however often they are read.
_ORDERLY = ("Project", "Filter", "Union", "LocalTableScan", "ColumnarToRow", "Scan ")


def repeatable(df: DataFrame) -> DataFrame:
    """``df`` if every evaluation gives its rows in one order, as scans of files do; else written once.

    After a shuffle, or in a task that a lost executor makes run again, rows may come in another order.
    """
    execution = df._jdf.queryExecution()
    nodes, orderly = [execution.sparkPlan()], execution.optimizedPlan().deterministic()
    while nodes and orderly:
        node = nodes.pop()
        orderly = node.nodeName().startswith(_ORDERLY) and node.nodeName() != "Scan ExistingRDD"
        children = node.children()
        nodes += [children.apply(k) for k in range(children.size())]
    return df if orderly else materialize(df)


def drop_tables(spark: SparkSession) -> None:
    """Deletes all tables that :func:`materialize` has written in this application; results that read them must be stored."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{sc.applicationId}")
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(id_col: Column, n: int) -> Column:
    """crc32 of the id as text, mod n: the fixed split of the query contracts.  Null ids give null."""
    return F.crc32(id_col.cast("string").cast("binary")) % n


def sample_ids(labels: DataFrame, id_col: str, n: int) -> DataFrame:
    """At most ``n`` ids, chosen by hash order, so the choice depends on neither row order nor partitions."""
    return labels.select(id_col).distinct().orderBy(F.xxhash64(F.lit(17), F.col(id_col)), id_col).limit(n)


def give_back() -> None:
    """Returns freed memory to the system: idle Python workers count against their executor."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def _libc():
    try:
        lib = ctypes.CDLL("libc.so.6")
        return lib if hasattr(lib, "malloc_trim") else None
    except OSError:  # another C library: nothing to do
        return None


_LIBC = _libc()


def text_steps(texts: pa.Array, step: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a text column into runs of whole rows of about ``step`` bytes.

    Yields (first row, row after the last, UTF-8 bytes, offsets from 0).  Null counts as empty.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi
    give_back()


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def doc_of(positions: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that holds each of the (ascending) byte positions."""
    return np.searchsorted(offsets, positions, "right") - 1


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: (starts, ends, row of each); words don't cross rows."""
    word = (data != 32) & ((data < 9) | (data > 13))
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, doc_of(starts, offsets)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE_CODES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64, for i < n."""
    if len(_POWERS[0]) < n:
        for k, base in ((0, _BASE), (1, _UNBASE)):
            p = np.full(max(n, STEP_BYTES + 4096), base, np.uint64)
            p[0] = 1
            _POWERS[k] = np.multiply.accumulate(p)
    return _POWERS[0], _POWERS[1]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Prefix polynomial hashes: H[i] covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each [start, end), from prefix hashes in constant time; equal bytes give equal hashes."""
    _, down = powers(len(prefix))
    return (prefix[ends] - prefix[starts]) * down[starts]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (xor-shift and multiply)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))
