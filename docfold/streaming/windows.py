"""Exact trailing windows: how many events of a key lie in the span before each row, over tables and streams."""

from __future__ import annotations

import bisect
import pickle
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HOUR_US = 3_600_000_000
#: Rows of one entry of a key's state.
RUN = 4096
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def trailing_count(rows: DataFrame, keys: list[str], ts: str, span_us: int, counted: Column | None = None, open_start: bool = False) -> DataFrame:
    """Adds ``trailing``: counted rows of the same keys in the ``span_us`` up to and including each row's time.

    The span's start counts too, unless ``open_start``.  Rows of one time see each other.  Time is cut into spans, and
    a row goes to its own span and, as context, to the next, so a key's rows are windowed in as many groups as it
    has spans: a key that holds most of the table is many tasks.  Rows without time count nothing.
    """
    at = micros(F.col(ts))
    dealt = rows.withColumn("_at", at).withColumn("_counted", (F.lit(True) if counted is None else F.coalesce(counted, F.lit(False))).cast("int"))
    own = F.floor(F.col("_at") / span_us)
    # Only what counts is context.
    spans = F.when(F.col("_counted") == 1, F.array(own, own + 1)).otherwise(F.array(own))
    dealt = dealt.withColumn("_own", own).withColumn("_span", F.explode(spans))
    w = Window.partitionBy(*keys, "_span").orderBy("_at").rangeBetween(-span_us + (1 if open_start else 0), 0)
    return dealt.withColumn("trailing", F.sum("_counted").over(w)).filter(F.col("_span").eqNullSafe(F.col("_own"))).drop("_at", "_counted", "_own", "_span")


class TrailingCounts(StatefulProcessor):
    """Rows wait until the watermark has passed them, and leave with the count of their span.

    State of a key: the rows that wait, and the times of rows that have left within the last span.  Both are lists of
    runs of up to RUN rows, as each entry read or written is a message to the state's server.  One timer is set, for the
    earliest row that waits, or for the moment when the last time leaves the span, which clears the state.
    """

    def __init__(self, key: str, columns: list[str], span_us: int) -> None:
        self.key, self.columns, self.span_us = key, columns, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "run binary")
        self.waiting = handle.getListState("waiting", "run binary")
        self.at = self.columns.index("at_us")
        self.row = Row(self.key, *self.columns, "trailing")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        wake, places = None, None
        while run := list(islice(rows, RUN)):
            places = places or [run[0].__fields__.index(c) for c in self.columns]
            run = [tuple([r[k] for k in places]) for r in run]
            self.waiting.appendValue((pickle.dumps(run),))
            first = min(r[self.at] for r in run)
            wake = first if wake is None else min(wake, first)
        if wake is not None:
            self._wake_at(wake)
        return iter([])

    def _wake_at(self, at: int) -> None:
        """One timer at the earliest moment asked for; watermarks count milliseconds."""
        ms = -(-at // 1000)
        known = [int(t[0] if isinstance(t, (tuple, list)) else t) for t in self.handle.listTimers()]
        if not known or ms < min(known):
            for t in known:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = int(timerValues.getCurrentWatermarkInMs()) * 1000
        k, done, left = self.at, [], []
        for (run,) in self.waiting.get():
            for r in pickle.loads(run):
                (done if r[k] <= passed else left).append(r)
        known = array("q")
        for (run,) in self.times.get():
            known.frombytes(run)
        # Rows that still wait are later than those that leave.
        ats = sorted([*known, *(r[k] for r in done)])
        # A row that comes later is later than the watermark, and looks back one span at most.
        oldest = passed - self.span_us
        if done:
            self.waiting.put([(pickle.dumps(left[x : x + RUN]),) for x in range(0, len(left), RUN)]) if left else self.waiting.clear()
        fresh = [r[k] for r in done if r[k] >= oldest]
        held = sum(a >= oldest for a in known)
        if 2 * held < len(known):
            # Times that no row will look back to are dropped when they are most of them.
            keep = ats[bisect.bisect_left(ats, oldest) :]
            self.times.put(self._runs(keep)) if keep else self.times.clear()
        elif fresh:
            self.times.appendList(self._runs(fresh))
        wake = min((r[k] for r in left), default=ats[-1] + self.span_us + 1 if held or fresh else None)
        if wake is not None:
            self.handle.registerTimer(-(-wake // 1000))
        for r in done:
            n = bisect.bisect_right(ats, r[k]) - bisect.bisect_left(ats, r[k] - self.span_us)
            yield self.row(key[0], *r, n)

    @staticmethod
    def _runs(ats: list[int]) -> list[tuple[bytes]]:
        return [(array("q", ats[x : x + RUN]).tobytes(),) for x in range(0, len(ats), RUN)]

    def close(self) -> None:
        pass


def stream_trailing_count(rows: DataFrame, key: str, ts: str, span_us: int, late: str = "1 hour") -> DataFrame:
    """:func:`trailing_count` over a stream, exactly: each row once, when the watermark has passed it.

    A row comes out when nothing earlier can arrive any more, so rows out of order within ``late`` are counted where
    they belong; rows later than that are dropped.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    marked = rows.withWatermark(ts, late).withColumn("at_us", micros(F.col(ts)))
    columns = [c for c in marked.columns if c not in (key, ts)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema if f.name in columns)
    out = marked.groupBy(key).transformWithState(
        statefulProcessor=TrailingCounts(key, columns, span_us), outputStructType=f"`{key}` {marked.schema[key].dataType.simpleString()}, {schema}, trailing bigint", outputMode="Append", timeMode="EventTime"
    )
    return out.withColumn(ts, F.timestamp_micros("at_us").cast(rows.schema[ts].dataType)).drop("at_us")


class SlidingCounts:
    """The step of a bucket of keys for :func:`stream_sliding_count`: messages go in, windows that have ended come out.

    ``given`` is the hour up to which windows have been given out; none of them is given out again.  The rest of the
    state is the counts of the hours that lie in a window still open, by key and hour.
    """

    def __init__(self, hours: int) -> None:
        self.hours = hours

    def __call__(self, bucket: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, known = None, (np.empty(0, object), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))
        if state.exists:
            given, packed = state.get
            known = pickle.loads(packed)
        if not state.hasTimedOut:
            known = self._add(known, batches)
        keys, codes, at, counts = known
        passed = state.getCurrentWatermarkMs() // 3_600_000
        last = None
        for out in self._ended(known, passed, given):
            last = max(int(out["stop"].max()) + self.hours, -(2**62) if last is None else last)
            yield out
        given = last if given is None else given if last is None else max(given, last)
        left = at + self.hours > passed
        if left.any():
            held, codes = np.unique(codes[left], return_inverse=True)
            state.update((given, pickle.dumps((keys[held], codes, at[left], counts[left]))))
            # The first window of an hour ends with it.
            wake = max(int(at[left].min()), passed) + 1
        elif given is not None and given + self.hours > passed:
            # A late row may still fall into a window that has been given out.
            state.update((given, pickle.dumps((keys[:0], codes[:0], at[:0], counts[:0]))))
            wake = given + self.hours
        else:
            state.remove()
            return
        # A state wakes when the watermark is later than this moment.
        state.setTimeoutTimestamp(wake * 3_600_000 - 1)

    @staticmethod
    def _add(known: tuple, batches: Iterator[pd.DataFrame]) -> tuple:
        """Counts by key and hour, in that order; rows are added up when there are more of them than counts."""
        fresh, n = [], 0

        def merged():
            keys, codes, at, counts = known
            place, names = pd.factorize(np.concatenate([keys, *(f["key"].to_numpy(object) for f in fresh)]), use_na_sentinel=False)
            codes = np.concatenate([place[: len(keys)][codes], place[len(keys) :]])
            at = np.concatenate([at, *(f["hour"].to_numpy(np.int64) for f in fresh)])
            counts = np.concatenate([counts, np.ones(n, np.int64)])
            order = np.lexsort((at, codes))
            codes, at = codes[order], at[order]
            first = np.flatnonzero(np.r_[True, (np.diff(codes) != 0) | (np.diff(at) != 0)])
            return names, codes[first], at[first], np.add.reduceat(counts[order], first)

        for f in batches:
            fresh.append(f)
            n += len(f)
            if n > max(len(known[1]), 100_000):
                known, fresh, n = merged(), [], 0
        return merged() if n else known

    def _ended(self, known: tuple, passed: int, given: int | None) -> Iterator[pd.DataFrame]:
        """Windows that hold a message and end by ``passed``, without those that end by ``given``, some at a time.

        A row stands for the windows that start from ``start`` to ``stop``, which have one count.
        """
        keys, codes, at, counts = known
        if not len(at) or at.min() + 1 > passed:
            return
        # Places on one line, on which the windows of two keys have no hour in common.
        base, width = int(at.min()) - self.hours, int(at.max() - at.min()) + 2 * self.hours + 1
        line, upto = codes * width + (at - base), np.concatenate([[0], np.cumsum(counts)])
        # An hour brings the windows that start after the hour before it.
        fresh = np.minimum(np.diff(line, prepend=line[0] - self.hours), self.hours)
        for x in range(0, len(line), RUN):
            n = fresh[x : x + RUN]
            starts = np.arange(n.sum()) + np.repeat(line[x : x + len(n)] + 1 - np.cumsum(n), n)
            owner = np.repeat(codes[x : x + len(n)], n)
            start = starts - owner * width + base
            keep = start + self.hours <= passed
            if given is not None:
                keep &= start + self.hours > given
            if keep.any():
                starts, owner, start = starts[keep], owner[keep], start[keep]
                messages = upto[np.searchsorted(line, starts + self.hours)] - upto[np.searchsorted(line, starts)]
                cut = np.r_[True, (np.diff(starts) != 1) | (np.diff(messages) != 0)]
                yield pd.DataFrame({"key": keys[owner[cut]], "start": start[cut], "stop": start[np.roll(cut, -1)], "count": messages[cut]})


def stream_sliding_count(rows: DataFrame, key: str, ts: str, hours: int, late: str = "1 hour", buckets: int = 1024) -> DataFrame:
    """Rows of a key in windows of ``hours`` that start every hour: ``key, start, count``, each window once, when the watermark has passed its end.

    ``F.window`` sends a row through the shuffle ``hours`` times and holds each window of a key in the state.  Here a
    row is sent once, and the state has a count for each hour of a key that lies in a window still open.  Keys share
    ``buckets``, whose counts are one entry of the state and are added up together; a key is an integer or a text.  A
    row that comes late counts in those of its windows that end after the last one that its bucket has given out.
    """
    # As wide as a row's last window, so that a row is late when none of its windows is open; the watermark is the same.
    last = (F.col(ts).cast("timestamp") + F.expr(f"interval {hours} hours")).alias("_last")
    name = F.col(key).cast("string").alias("key")
    dealt = rows.filter(F.col(ts).isNotNull()).select(F.pmod(F.hash(key), F.lit(buckets)).alias("bucket"), name, F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / 3600).alias("hour"), last).withWatermark("_last", f"{late} {hours} hours")
    out = dealt.groupBy("bucket").applyInPandasWithState(SlidingCounts(hours), "key string, start bigint, stop bigint, count bigint", "given bigint, counts binary", "append", GroupStateTimeout.EventTimeTimeout)
    each = out.select(F.col("key").cast(rows.schema[key].dataType).alias(key), F.explode(F.sequence("start", "stop")).alias("start"), "count")
    return each.withColumn("start", F.timestamp_seconds(F.col("start") * 3600))


def exact_quota(messages: DataFrame, hours: int = 24, limit: int | Column = 100, late: str = "1 hour") -> DataFrame:
    """R2, exact: each user message of ``event_id, user_id, ts, role`` with its user's count of the last ``hours``.

    ``messages`` has the count of user messages from ``ts - hours`` on (that moment included) up to this one, and
    ``over_limit`` says whether it is more than ``limit``.  The same on a stream as on a table.
    """
    mine = messages.filter("role = 'user'").drop("role")
    counted = stream_trailing_count(mine, "user_id", "ts", hours * HOUR_US, late) if messages.isStreaming else trailing_count(mine, ["user_id"], "ts", hours * HOUR_US)
    return counted.select("event_id", "user_id", "ts", F.col("trailing").alias("messages"), (F.col("trailing") > limit).alias("over_limit"))


def cache_hits(requests: DataFrame, writes: DataFrame, hours: int = 1, late: str = "10 minutes") -> DataFrame:
    """Each request of ``request_id, user_id, query_hash, ts`` once, with ``hit``.

    A request is a hit if the same user and query were written in the ``hours`` before it: from ``ts - hours`` on,
    that moment left out, as an entry that ends now isn't served, up to ``ts`` itself.  Streams meet in an outer join
    whose state leaves with both watermarks: a request is a miss when no write for it can arrive any more.
    Later rows are dropped; a write without user or query moves no watermark.  Tables are answered from one window, without pairs of requests and writes.
    """
    keys = ["user_id", "query_hash"]
    if not requests.isStreaming:
        asked = requests.select("request_id", *keys, "ts", F.lit(False).alias("_write"))
        known = writes.dropna(subset=keys)
        both = asked.unionByName(known.select(F.lit(None).cast(requests.schema["request_id"].dataType).alias("request_id"), *keys, "ts", F.lit(True).alias("_write")))
        counted = trailing_count(both, keys, "ts", hours * HOUR_US, F.col("_write"), open_start=True)
        return counted.filter("not _write").select("request_id", *keys, "ts", (F.coalesce("trailing", F.lit(0)) > 0).alias("hit"))
    r = requests.withWatermark("ts", late).alias("r")
    w = writes.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("ts").alias("_ts")).withWatermark("_ts", late).alias("w")
    within = (F.col("_ts") <= F.col("ts")) & (F.col("_ts") > F.col("ts") - F.expr(f"interval {hours} hours"))
    met = r.join(w, (F.col("user_id") == F.col("_user_id")) & (F.col("query_hash") == F.col("_query_hash")) & within, "left_outer")
    # Several writes may match; which of them comes first makes no difference.
    return met.select("request_id", *keys, "ts", F.col("_ts").isNotNull().alias("hit")).dropDuplicatesWithinWatermark(["request_id"])
