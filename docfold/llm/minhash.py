"""Near-duplicate detection: fast similarity sketching, banding, and exact verification.

A sketch has one coordinate per bin.  In each of the first rounds every element falls into one hashed bin; in
as many rounds after those, every element goes to one given bin, so that every coordinate fills.  A coordinate
keeps its earliest round's smallest hash.  Most sets fill all bins in a round or two, and the share of equal
coordinates estimates the Jaccard similarity with concentration bounds.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_batches, materialize, mix, prefix_hashes, span_hashes, text_steps, word_spans
from .graph import connected_components

BINS = 128
EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, ascending in it, and the row of each.

    Words are ``[^\\x20\\x09-\\x0D]+`` after A-Z to a-z.  Rows with fewer than ``width`` words have their whole
    sequence as one shingle; rows without words have none.
    """
    data = ascii_lower(data)
    starts, ends, row = word_spans(data, offsets)
    # Apart words keep apart: a word's hash is mixed before words are joined.
    h = mix(span_hashes(prefix_hashes(data), starts, ends))
    base = np.uint64(0xD6E8FEB86659FD93)
    n = np.bincount(row, minlength=len(offsets) - 1)
    if len(h) >= width:
        sh = np.zeros(len(h) - width + 1, np.uint64)
        for j in range(width):
            sh = sh * base + h[j : len(h) - width + 1 + j]
        at = row[: len(sh)]
        ok = at == row[width - 1 :]
        sh, at = sh[ok], at[ok]
    else:
        sh, at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    few = np.flatnonzero((n > 0) & (n < width))
    if len(few):
        begin = np.concatenate([[0], np.cumsum(n)])
        more = [reduce(lambda x, y: x * int(base) + y & (1 << 64) - 1, h[begin[k] : begin[k + 1]].tolist(), int(n[k])) for k in few]
        sh, at = np.concatenate([sh, np.array(more, np.uint64)]), np.concatenate([at, few])
    sh = mix(sh)
    order = np.lexsort((sh, at))
    sh, at = sh[order], at[order]
    fresh = np.ones(len(sh), bool)
    fresh[1:] = (sh[1:] != sh[:-1]) | (at[1:] != at[:-1])
    return sh[fresh], at[fresh]


def sketches(shingles: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Sketch of each row's set, rows x BINS; EMPTY throughout for empty sets."""
    out = np.full(rows * BINS, EMPTY, np.uint64)
    sh, at = shingles, row
    for r in range(2 * BINS):
        if not len(sh):
            break
        h = mix(sh + np.uint64(r * 0x9FB21C651E98DF25 % (1 << 64)))
        value = (h >> np.uint64(8)) | (np.uint64(r) << np.uint64(56))
        b = (h & np.uint64(BINS - 1)).astype(np.int64) if r < BINS else r - BINS
        np.minimum.at(out, at * BINS + b, value)
        open_rows = (out.reshape(rows, BINS) == EMPTY).any(1)
        live = open_rows[at]
        if not live.all():
            sh, at = sh[live], at[live]
    return out.reshape(rows, BINS)


def band_keys(sketch: np.ndarray, bands: int, width: int) -> np.ndarray:
    """One 64-bit key per band."""
    keys = np.zeros((len(sketch), bands), np.uint64)
    for j in range(width):
        keys = mix(keys * np.uint64(31) + sketch[:, j : bands * width : width])
    return mix(keys + np.arange(bands, dtype=np.uint64)[None, :])


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|, for arrays of distinct values."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return bool(both) and 100 * both >= percent * (len(a) + len(b) - both)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, shingle: int = 5, bands: int = 25, band_width: int = 5, block: int = 1024) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for each row.

    Links join texts whose shingle sets have a Jaccard similarity of ``percent`` / 100 or more, confirmed on the
    full sets; the component is the smallest id reachable by links.  25 bands of 5 coordinates miss a pair at
    0.85 with probability 4e-7, at 0.8 with 5e-5; nothing else is left to chance.

    A set holds 64-bit hashes of its shingles: no link is lost, and a false one would take many collisions in one
    pair.  Equal sets (by a 128-bit hash) form a class, and only one row per class is compared.  Within a bucket every
    class is first compared with two hubs; where a bucket still spans several components, its members outside
    the largest one are compared with all others in blocks of ``block``, on full sets, and only links that join
    two components of the task are given out (see :func:`across_components`).

    Null and empty texts have no shingles and link with nothing.  Rows that repeat an id are one document: its
    texts are all compared, and all its rows have one component.  Null ids are never linked and keep a null
    component.  An empty table gives no rows; other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_steps(b.column(1)):
                sh, at = shingle_sets(data, offsets, shingle)
                n = np.bincount(at, minlength=hi - lo)
                keys = band_keys(sketches(sh, at, hi - lo), bands, band_width).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(n, pa.int64()), set_hashes(sh, n), pa.array(list(keys), pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node", "bands"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offsets in text_steps(b.column(1)):
                sh, at = shingle_sets(data, offsets, shingle)
                n = np.bincount(at, minlength=hi - lo)
                cut = np.concatenate([[0], np.cumsum(n)]).tolist()
                yield pa.RecordBatch.from_arrays([set_hashes(sh, n), pa.array([sh[x:y].tobytes() for x, y in zip(cut, cut[1:])], pa.binary())], ["node", "shingles"])

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hit = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(hit, pa.bool_()))

    # A class is named by the 128-bit hash of its set.
    told = materialize(rows.mapInArrow(sketch, f"doc_id {id_type}, n_shingles long, node binary, bands array<long>"))
    usable = told.filter("n_shingles > 0 and doc_id is not null")
    classes = materialize(usable.groupBy("node").agg(F.min("doc_id").alias("least"), F.min_by("bands", "doc_id").alias("bands"), F.first("n_shingles").alias("n_shingles")))
    keyed = classes.select("node", "least", "n_shingles", F.explode("bands").alias("key"))
    # Buckets of several classes, with two hubs: the smallest and the largest name.
    hubs = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub"), F.max("node").alias("other_hub")).filter("size > 1")
    buckets = materialize(keyed.join(hubs, "key"))
    # Sets of all that any pair can name, gathered once.
    named = rows.join(buckets.select(F.col("least").alias("doc_id")).distinct(), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    full = materialize(named.mapInArrow(sets, "node binary, shingles binary"))

    def links(pairs: DataFrame) -> DataFrame:
        first = pairs.join(full.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
        whole = first.join(full.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
        return whole.select("a", "b", "of_a", "of_b").mapInArrow(confirm, "a binary, b binary")

    # An id with several texts links their classes.
    several = usable.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    shared = usable.join(several, "doc_id").filter("node <> a").select("a", F.col("node").alias("b"))
    found = materialize(links(buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()).unionByName(shared))
    joined = connected_components(found)
    for step in ("hubs", "blocks"):
        # Each bucket's members with their component so far.
        placed = buckets.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
        split = placed.groupBy("key").agg(F.min("component").alias("first"), F.max("component").alias("last")).filter("first <> last").select("key")
        open_ = materialize(placed.join(split, "key").select("key", "node", "component", "other_hub", "n_shingles"))
        if open_.isEmpty():
            break
        if step == "hubs":
            hub = open_.filter("node = other_hub").select("key", F.col("node").alias("a"), F.col("component").alias("of_a"))
            more = materialize(links(open_.join(hub, "key").filter("component <> of_a").select("a", F.col("node").alias("b")).distinct()))
        else:
            more = materialize(across_components(open_, full, percent, block))
        if not more.isEmpty():
            found = found.unionByName(more)
            joined = connected_components(found)
    # The smallest id of a component names it.
    member = classes.join(joined, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    names = member.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = usable.select("doc_id", "n_shingles", "node").join(member.select("node", "component").join(names, "component").drop("component"), "node").select("doc_id", "n_shingles", "component_id")
    alone = told.filter("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def set_hashes(shingles: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """128-bit hash of each row's set: two sums of mixed shingles, and its size is mixed in."""
    end = np.cumsum(sizes)
    out = np.zeros((len(sizes), 2), np.uint64)
    for k in (0, 1):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles + np.uint64(k + 1)), dtype=np.uint64)])
        out[:, k] = mix((total[end] - total[end - sizes]) ^ (sizes.astype(np.uint64) << np.uint64(40 * k)))
    return pa.array([x.tobytes() for x in out], pa.binary())


class Home:
    """Members of one task that all others are compared with, and the components that links join so far.

    Sets at or above the threshold share one of their first ``n - ceil(n * percent / 100) + 1`` shingles in any
    common order, so only members that share one of those are looked at; rare shingles come first.
    """

    def __init__(self, sets: list[np.ndarray], percent: int) -> None:
        self.percent = percent
        self.sizes = np.array([len(x) for x in sets])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        self.known, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        #: Place of each shingle in the common order.
        self.place = np.empty(len(count), np.int64)
        self.place[np.argsort(count, kind="stable")] = np.arange(len(count))
        self.whole = self._lists(token, owner)
        at = np.lexsort((self.place[token], owner))
        nth = np.arange(len(at)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        lead = at[nth < np.repeat(self.lead(self.sizes), self.sizes)]
        self.leads = self._lists(token[lead], owner[lead])

    def lead(self, n: np.ndarray | int) -> np.ndarray | int:
        return n - -(-n * self.percent // 100) + 1

    def _lists(self, token: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(token, kind="stable")
        return np.concatenate([[0], np.cumsum(np.bincount(token, minlength=len(self.known)))]), owner[order]

    @staticmethod
    def _of(lists: tuple[np.ndarray, np.ndarray], tokens: np.ndarray) -> np.ndarray:
        begin, owners = lists
        n = begin[tokens + 1] - begin[tokens]
        return owners[np.repeat(begin[tokens] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]

    def similar_to(self, one: np.ndarray, open_: np.ndarray) -> np.ndarray:
        """Members, of those marked in ``open_``, whose similarity with ``one`` reaches the threshold."""
        at = np.minimum(np.searchsorted(self.known, one), len(self.known) - 1)
        tokens = at[self.known[at] == one]
        # Shingles that no member has come before all others.
        few = int(self.lead(len(one))) - (len(one) - len(tokens))
        if few <= 0:
            return np.zeros(0, np.int64)
        first = tokens if few >= len(tokens) else tokens[np.argpartition(self.place[tokens], few - 1)[:few]]
        likely = np.unique(self._of(self.leads, first))
        likely = likely[open_[likely] & (100 * np.minimum(self.sizes[likely], len(one)) >= self.percent * np.maximum(self.sizes[likely], len(one)))]
        if not len(likely):
            return likely
        both = np.bincount(self._of(self.whole, tokens), minlength=len(self.sizes))[likely]
        return likely[100 * both >= self.percent * (self.sizes[likely] + len(one) - both)]


class Forest:
    """Components that links of one task join; a component is any hashable name."""

    def __init__(self) -> None:
        self.above: dict = {}

    def root(self, x):
        while (up := self.above.get(x, x)) != x:
            self.above[x] = self.above.get(up, up)
            x = self.above[x]
        return x

    def join(self, x, y) -> bool:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.above[y] = x
        return x != y


def across_components(open_: DataFrame, full: DataFrame, percent: int, block: int) -> DataFrame:
    """``a, b``: confirmed links that join different components of one bucket.

    Members outside a bucket's largest component are dealt into parts of about ``block`` members and 2**20
    shingles.  A part is compared with itself, with higher parts, and with the largest component, whose members
    come in slices: a task holds one part and streams the others past it.  It gives out only links that join
    two components which its earlier links hadn't joined, so at most one row per member.
    """
    # Buckets with the same members are one.
    same = open_.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node") % (1 << 40)).alias("x"), F.sum(F.xxhash64(F.lit(1), "node") % (1 << 40)).alias("y"))
    one = same.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    sums = open_.groupBy("key", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    largest = sums.groupBy("key").agg(F.max(F.struct("m", "component", "s")).alias("top"), F.sum("m").alias("m"), F.sum("s").alias("s"))
    pieces = lambda m, s, k: F.greatest(F.ceil(m / (k * block)), F.ceil(s / (k << 20))).cast("int")
    plan = one.join(largest, "key").select("key", F.col("top.component").alias("main"), pieces(F.col("m") - F.col("top.m"), F.col("s") - F.col("top.s"), 1).alias("parts"), pieces(F.col("top.m"), F.col("top.s"), 16).alias("slices"))
    members = open_.join(plan, "key").withColumn("home", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    what = ["node", "component"]
    below = F.when(F.col("component") == F.col("main"), F.col("parts")).otherwise(F.col("home"))
    met = members.select("key", F.explode(F.when(below > 0, F.sequence(F.lit(0), below - 1))).alias("part"), F.pmod(F.xxhash64(F.lit(9), "node"), F.col("slices")).cast("int").alias("slice"), F.lit(1).alias("role"), *what)
    own = members.filter("component <> main").select("key", F.col("home").alias("part"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), *what)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, role, home, names, components, forest = None, 0, None, [], [], Forest()
        held: list[np.ndarray] = []

        def close() -> list[tuple[bytes, bytes]]:
            """The part's own members are all there: compare them with each other."""
            nonlocal home
            home = Home(held, percent)
            out = []
            if at[2] == 0:
                for k in range(1, len(held)):
                    out += meet(names[k], components[k], held[k], np.arange(len(held)) < k)
            return out

        def meet(node: bytes, component: bytes, one: np.ndarray, open_: np.ndarray) -> list[tuple[bytes, bytes]]:
            return [(names[k], node) for k in home.similar_to(one, open_).tolist() if forest.join(components[k], component)]

        def table(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.binary()) for k in (0, 1)], ["a", "b"])

        for b in batches:
            out: list[tuple[bytes, bytes]] = []
            for key, part, slice_, role, node, component, shingles in zip(*(b.column(k).to_pylist() for k in ("key", "part", "slice", "role", "node", "component", "shingles"))):
                if (key, part, slice_) != at:
                    if home is None and held:
                        out += close()
                    at, home, names, components, held, forest = (key, part, slice_), None, [], [], [], Forest()
                one = np.frombuffer(shingles, np.uint64)
                if role == 0:
                    names.append(node)
                    components.append(component)
                    held.append(one)
                elif held:
                    if home is None:
                        out += close()
                    out += meet(node, component, one, np.ones(len(held), bool))
            yield table(out)
        if home is None and held:
            yield table(close())

    order = ["key", "part", "slice"]
    dealt = met.unionByName(own).join(full, "node").repartition(*order).sortWithinPartitions(*order, "role", "node")
    return dealt.mapInArrow(compare, "a binary, b binary").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`near_duplicates` keeps."""
    stays = near_duplicates(docs, id_col, text_col, percent).filter("kept").select(F.col("doc_id").alias("_stays")).distinct()
    return docs.join(stays, docs[id_col].eqNullSafe(stays["_stays"]), "left_semi")
