"""Streams fed batch by batch: order, late rows, state that leaves, and replays."""

import datetime
import random
import time
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docfold.streaming import jobs, windows

START = datetime.datetime(2024, 1, 1)
EVENTS = "event_id long, user_id long, ts timestamp, role string"


def minutes(n):
    return START + datetime.timedelta(minutes=n)


class Feed:
    """A folder whose files arrive one by one, a batch each."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema, self.n = spark, str(path), schema, 0

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.parquet(f"{self.path}/f={self.n:03d}")
        self.n += 1
        time.sleep(0.02)  # files are taken by their time

    def read(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(self.path)


@pytest.fixture
def drained(tmp_path):
    """Runs a stream over what is there so far; a second call goes on from the first one's checkpoint."""
    got = {}

    def run(df):
        # A batch that runs again replaces its rows.
        jobs.drain(df, lambda batch, n: got.__setitem__(n, batch.collect()), str(tmp_path / "checkpoint"))
        return [r for n in sorted(got) for r in got[n]]

    return run


def plain_counts(rows, span=1440):
    return {i: sum(1 for _, v, s, _ in rows if v == u and t - datetime.timedelta(minutes=span) <= s <= t) for i, u, t, _ in rows}


def test_exact_quota_out_of_order_over_batches(spark, tmp_path, drained):
    """Rows out of order within the allowed time are counted where they belong; ties see each other."""
    rng = random.Random(1)
    rows = [(i, rng.choice([1, 1, 1, 2, 3]), minutes(7 * i + rng.randrange(-50, 1) if i % 3 else 7 * (i // 5) * 5), "user") for i in range(600)]
    rows.insert(100, (9000, 2, rows[10][2] + datetime.timedelta(days=1), "user"))
    feed = Feed(spark, tmp_path / "in", EVENTS)
    for lo in range(0, len(rows), 120):
        feed.add(rows[lo : lo + 120])
    feed.add([(9999, 9, minutes(10**6), "user")])
    got = {r.event_id: r for r in drained(windows.exact_quota(feed.read(), limit=100, late="12 hours"))}
    want = plain_counts(rows)
    assert set(got) == set(want)
    assert {i: r.messages for i, r in got.items()} == want
    assert all(r.over_limit == (want[i] > 100) for i, r in got.items()) and any(r.over_limit for r in got.values())
    table = windows.exact_quota(spark.createDataFrame(rows, EVENTS), limit=100).collect()
    assert {r.event_id: r.messages for r in table} == want


def test_exact_quota_late_rows_and_roles(spark, tmp_path, drained):
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.add([(1, 1, minutes(0), "user"), (2, 1, minutes(10), "assistant"), (3, 1, minutes(600), "user")])
    feed.add([(5, 1, minutes(601), "user")])
    feed.add([(4, 1, minutes(5), "user"), (6, 1, minutes(1440), "user")])  # row 4 is too late
    feed.add([(7, 1, minutes(1441), "user"), (8, 2, minutes(9999), "user")])
    feed.add([(9, 2, minutes(99999), "user")])
    feed.add([(10, 2, minutes(999999), "user")])
    got = {r.event_id: r.messages for r in drained(windows.exact_quota(feed.read(), late="30 minutes"))}
    assert got == {1: 1, 3: 2, 5: 3, 6: 4, 7: 4, 8: 1, 9: 1}


def test_exact_quota_state_leaves(spark, tmp_path):
    """A user that stays away leaves no state behind."""
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.add([(i, i % 5, minutes(i), "user") for i in range(50)])
    feed.add([(100, 99, minutes(100_000), "user")])
    feed.add([(101, 99, minutes(200_000), "user")])
    q = windows.exact_quota(feed.read()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "times").option("operatorId", 0).load()
    assert {r.key.user_id for r in rows.select("key").collect()} <= {99}


def test_exact_quota_of_a_hot_user_is_many_groups(spark):
    """One user with all rows is windowed in as many groups as there are days."""
    rows = spark.range(3000).select(F.col("id").alias("event_id"), F.lit(1).alias("user_id"), (F.timestamp_seconds(F.col("id") * 600)).alias("ts"), F.lit("user").alias("role"))
    got = windows.exact_quota(rows)
    assert "_span" in got._jdf.queryExecution().executedPlan().toString()
    assert [r.messages for r in got.orderBy("event_id").collect()] == [min(i + 1, 145) for i in range(3000)]


class Listed:
    """A list state in memory that counts the messages it gets."""

    def __init__(self, calls):
        self.rows, self.calls = [], calls

    def get(self):
        self.calls.append("get")
        return iter(list(self.rows))

    def appendValue(self, value):
        self.calls.append("append")
        self.rows.append(value)

    def appendList(self, values):
        self.calls.append("append")
        self.rows += values

    def put(self, values):
        self.calls.append("put")
        self.rows = list(values)

    def clear(self):
        self.calls.append("clear")
        self.rows = []


class Handle:
    def __init__(self):
        self.calls, self.timers, self.states = [], set(), {}

    def getListState(self, name, schema):
        return self.states.setdefault(name, Listed(self.calls))

    def listTimers(self):
        return iter(sorted((t,) for t in self.timers))

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


def test_trailing_counts_state_takes_runs_not_rows(monkeypatch):
    """Messages to the state follow batches, not rows; runs, times that leave, and rows that wait longer stay exact."""
    monkeypatch.setattr(windows, "RUN", 500)
    rng, span = random.Random(3), 1000_000
    got, rows, calls = [], [], []
    handle = Handle()
    p = windows.TrailingCounts("user_id", ["event_id", "at_us"], span)
    p.init(handle)
    asked = Row("user_id", "event_id", "at_us")

    def clock(ms):
        return SimpleNamespace(getCurrentWatermarkInMs=lambda: ms)

    for batch in range(30):
        fresh = [asked(1, len(rows) + i, (batch * 400 + rng.randrange(600)) * 1000) for i in range(1200 if batch % 7 == 0 else 60)]
        rows += fresh
        handle.calls.clear()
        assert list(p.handleInputRows((1,), iter(fresh), clock(batch * 400))) == []
        now = (batch + 1) * 400 if batch < 29 else 10**9
        while due := [t for t in handle.timers if t <= now]:
            handle.timers -= set(due)
            got += list(p.handleExpiredTimer((1,), clock(now), None))
        calls.append(len(handle.calls))
    assert max(calls) <= 8 and not any(s.rows for s in handle.states.values()) and not handle.timers
    at = np.array([r.at_us for r in rows])
    want = {r.event_id: int(((at >= a - span) & (at <= a)).sum()) for r, a in zip(rows, at)}
    assert len(got) == len(rows) and {r.event_id: r.trailing for r in got} == want


def plain_windows(rows, end=10**12):
    """Messages by user and hour in which a window starts, of windows that end by ``end``."""
    out = Counter()
    for _, u, t, role in rows:
        if role == "user" and t is not None:
            h = int((t - START).total_seconds() // 3600)
            out.update((u, s) for s in range(h - 23, h + 1) if s + 24 <= end)
    return out


def windows_of(rows):
    got = [((r.user_id, int((r.window_start - START).total_seconds() // 3600)), r.messages) for r in rows if r.user_id != -1]
    assert len(got) == len(dict(got))
    assert all(r.over_limit == (r.messages > 100) and r.window_end - r.window_start == datetime.timedelta(days=1) for r in rows)
    return dict(got)


def test_rolling_quota_out_of_order_over_batches(spark, tmp_path, drained):
    """Each window once, as on a table; moments on the hour, rows without user or time, and gaps longer than a window."""
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, 3, None]), minutes((4 * i + rng.randrange(-90, 1) if i % 4 else 4 * i // 60 * 60) + (6000 if i >= 400 else 0)), rng.choice(["user", "user", "assistant"])) for i in range(700)]
    rows += [(1000, 4, None, "user"), (1001, 5, minutes(60), "user"), (1002, 5, minutes(60) - datetime.timedelta(microseconds=1), "user")]
    rows = rows[-3:] + rows[:-3]
    feed = Feed(spark, tmp_path / "in", EVENTS)
    for lo in range(0, len(rows), 100):
        feed.add(rows[lo : lo + 100])
    feed.add([(9999, -1, minutes(10**6), "user")])
    got = windows_of(drained(jobs.rolling_quota(feed.read(), late="3 hours")))
    assert got == plain_windows(rows) and max(got.values()) > 100
    assert windows_of(jobs.rolling_quota(spark.createDataFrame(rows, EVENTS)).collect()) == got


def test_rolling_quota_late_rows(spark, tmp_path, drained):
    """A late row counts in its windows that are open, changes none that is given out, and gives none out twice."""
    feed = Feed(spark, tmp_path / "in", EVENTS)
    first = [(1, 1, minutes(0), "user"), (2, 1, minutes(1500), "user")]  # then windows up to hour 24 are out
    feed.add(first), feed.add([(3, -1, minutes(1500), "user")]), feed.add([(4, -1, minutes(1500), "user")])
    late = [(5, 1, minutes(610), "user"), (6, 1, minutes(1499), "user")]
    feed.add([*late, (7, 1, minutes(0), "user")])  # no window of row 7 is open
    feed.add([(8, -1, minutes(10**6), "user")])
    got = windows_of(drained(jobs.rolling_quota(feed.read(), late="1 hour")))
    assert got == plain_windows(first, 24) + Counter({w: n for w, n in plain_windows(first + late).items() if w[1] > 0})


def test_rolling_quota_state_is_hours_not_windows(spark, tmp_path):
    """The state has an entry for some users together, not one for each window of a user, and leaves with them."""
    feed = Feed(spark, tmp_path / "in", EVENTS)
    feed.add([(i, i % 5, minutes(30 * i), "user") for i in range(500)])
    feed.add([(1000, 99, minutes(100_000), "user")])
    feed.add([(1001, 99, minutes(200_000), "user")])
    q = jobs.rolling_quota(feed.read()).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress]
    assert 0 < max(held) <= 6 and held[-1] == 1


class Held:
    """State of a group in memory."""

    def __init__(self):
        self.exists, self.get, self.hasTimedOut, self.watermark, self.wake = False, None, False, 0, None

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.exists, self.get = True, value

    def remove(self):
        self.exists, self.get = False, None

    def setTimeoutTimestamp(self, ms):
        assert ms >= self.watermark
        self.wake = ms


def test_sliding_counts_in_small_runs(monkeypatch):
    """Runs of one count and steps of few hours add up to the plain windows; a wake-up gives out what has ended."""
    monkeypatch.setattr(windows, "RUN", 7)
    rng, step, state = random.Random(8), windows.SlidingCounts(24), Held()
    rows, got = [], Counter()
    for batch in range(40):
        fresh = [(rng.choice(["a", "b", "c", None]), 500_000 + batch * 3 + rng.randrange(3)) for _ in range(rng.choice([0, 3, 40]))]
        rows += fresh
        state.watermark = (500_000 + batch * 3) * 3_600_000 if batch < 39 else 10**13
        state.hasTimedOut = not fresh
        if state.hasTimedOut and not (state.exists and state.wake < state.watermark):
            continue
        frames = [pd.DataFrame({"key": [k for k, _ in part], "hour": [h for _, h in part]}) for part in (fresh[:5], fresh[5:]) if part]
        for out in step((0,), iter(frames), state):
            for k, a, b, n in out.itertuples(index=False):
                for s in range(a, b + 1):
                    k = None if pd.isna(k) else k
                    assert (k, s) not in got and s + 24 <= state.watermark // 3_600_000
                    got[k, s] = n
    state.hasTimedOut = True
    assert not state.exists or not list(step((0,), iter([]), state))
    assert got == Counter((k, s) for k, h in rows for s in range(h - 23, h + 1)) and not state.exists


HIT = "request_id long, user_id long, query_hash string, ts timestamp"
WRITE = "user_id long, query_hash string, ts timestamp"


def test_cache_hits_over_batches(spark, tmp_path, drained):
    asks, writes = Feed(spark, tmp_path / "asks", HIT), Feed(spark, tmp_path / "writes", WRITE)
    a = [(1, 1, "q", minutes(0)), (2, 1, "q", minutes(30)), (3, 1, "q", minutes(90)), (4, 2, "q", minutes(30)), (5, 1, "r", minutes(30)), (6, 1, "q", minutes(89)), (7, None, "q", minutes(30)), (8, 1, "q", minutes(29))]
    w = [(1, "q", minutes(30)), (1, "q", minutes(29)), (1, "q", minutes(30)), (1, "r", minutes(31)), (3, "q", minutes(20)), (None, "q", minutes(30))]
    want = {1: False, 2: True, 3: False, 4: False, 5: False, 6: True, 7: False, 8: True}
    asks.add(a[:4]), writes.add(w[:2])
    asks.add(a[4:]), writes.add(w[2:])
    for n in (1000, 2000, 3000):
        asks.add([(n, 9, "end", minutes(n))]), writes.add([(9, "end", minutes(n))])
    # Both are far past the first two batches by now, so this request is too late, and so is this write.
    asks.add([(50, 1, "q", minutes(40)), (51, 4, "z", minutes(3000))]), writes.add([(4, "z", minutes(2000))])
    for n in (9000, 9999):
        asks.add([(n, 9, "end", minutes(n))]), writes.add([(9, "end", minutes(n))])
    got = [(r.request_id, r.hit) for r in drained(windows.cache_hits(asks.read(), writes.read(), late="2 hours"))]
    assert len(got) == len(dict(got))
    assert {i: h for i, h in got if i < 50} == want and 50 not in dict(got) and dict(got)[51] is False
    table = windows.cache_hits(spark.createDataFrame(a, HIT), spark.createDataFrame(w, WRITE)).collect()
    assert {r.request_id: r.hit for r in table} == want
