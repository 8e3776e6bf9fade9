"""Tables kept up by merges: folders by a hash of a key, replaced a version at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Version:
    """What a table consists of: for each of ``buckets`` folders the version that wrote it, and its rows."""

    number: int
    buckets: int
    written: dict[int, int]
    rows: dict[int, int]


class BucketTable:
    """A Parquet table of ``schema`` under ``path``, in folders by a hash of ``key``.

    A merge reads the folders that the changed keys fall into, writes them anew under its own version, and then
    publishes the version in one small file that is renamed into place.  Until then readers see the version before,
    so a driver or executor lost on the way loses nothing; a merge that runs again under its number replaces what it had
    begun, and one that had been published does nothing.  Folders that neither the last two versions name are deleted.

    A table starts with one folder and doubles their number when they hold more than ``bucket_rows`` rows each, so a
    small batch on a large table rewrites few of many folders.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, bucket_rows: int = 1_000_000) -> None:
        self.spark, self.path, self.schema, self.key, self.bucket_rows = spark, path.rstrip("/"), schema, key, bucket_rows

    # ---- files ----
    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def delete(self, path: str) -> None:
        fs, p = self._fs(path)
        fs.delete(p, True)

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names(f"{self.path}/versions") if n.endswith(".json"))

    def current(self, number: int | None = None) -> Version | None:
        """The last published version, or the one of that number."""
        known = self.versions()
        if not known:
            return None
        number = known[-1] if number is None else number
        body = json.loads("".join(r.value for r in self.spark.read.text(f"{self.path}/versions/{number}.json").collect()))
        return Version(number, body["buckets"], *({int(k): v for k, v in body[x].items()} for x in ("written", "rows")))

    def publish(self, v: Version) -> None:
        fs, draft = self._fs(f"{self.path}/drafts/{v.number}-{uuid.uuid4().hex}")
        out = fs.create(draft)
        out.write(bytearray(json.dumps({"buckets": v.buckets, "written": v.written, "rows": v.rows}).encode()))
        out.close()
        _, folder = self._fs(f"{self.path}/versions")
        fs.mkdirs(folder)
        _, final = self._fs(f"{self.path}/versions/{v.number}.json")
        if not fs.rename(draft, final):
            raise RuntimeError(f"version {v.number} of {self.path} could not be published")

    # ---- rows ----
    def bucket(self, buckets: int, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(buckets)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The table, or the rows of some of its folders; no other folder is opened."""
        return self._of(self.current(), buckets)

    def read_keys(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys(key)``: from their folders alone."""
        v = self.current()
        hit = [] if v is None else [r.b for r in keys.select(self.bucket(v.buckets).alias("b")).distinct().collect()]
        return self._of(v, hit).join(keys.select(self.key).distinct(), self.key, "left_semi")

    def _of(self, v: Version | None, buckets: list[int] | None = None) -> DataFrame:
        paths = [] if v is None else [f"{self.path}/data/version={n}/bucket={b}" for b, n in sorted(v.written.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame], number: int | None = None) -> bool:
        """Replaces the folders that ``changes`` fall into by ``how(their rows, changes)``; false if ``number`` is published.

        ``how`` may only give rows whose keys the folders hold or the changes name.
        """
        known = self.versions()
        number = (known[-1] + 1 if known else 0) if number is None else number
        if known and number <= known[-1]:
            return False
        now = self.current() or Version(-1, 1, {}, {})
        buckets = now.buckets
        while sum(now.rows.values()) > self.bucket_rows * buckets:
            buckets *= 2
        hit = [r.b for r in changes.select(self.bucket(now.buckets).alias("b")).distinct().collect()]
        if buckets != now.buckets:
            hit = sorted(set(hit) | set(now.written))
        merged = how(self._of(now, hit), changes)
        folder = f"{self.path}/data/version={number}"
        columns = self.spark.createDataFrame([], self.schema).columns
        # Rebalanced by AQE: many small folders in one task, a large one in several.
        merged.select(*columns).withColumn("bucket", self.bucket(buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(folder)
        names = {int(n.removeprefix("bucket=")) for n in self._names(folder) if n.startswith("bucket=")}
        rows = {r.bucket: r.n for r in self.spark.read.parquet(folder).groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).collect()} if names else {}
        kept = {} if buckets != now.buckets else {b: n for b, n in now.written.items() if b not in hit}
        self.publish(Version(number, buckets, kept | {b: number for b in names}, {b: n for b, n in now.rows.items() if b in kept} | rows))
        self._sweep()
        return True

    def _sweep(self) -> None:
        """Deletes folders that the last two versions don't name, and older versions' files."""
        known = self.versions()
        named = {(n, b) for v in known[-2:] for b, n in self.current(v).written.items()}
        for name in self._names(f"{self.path}/data"):
            n = int(name.removeprefix("version="))
            if n > known[-1]:
                continue
            held = [x for x in self._names(f"{self.path}/data/{name}") if x.startswith("bucket=")]
            gone = [x for x in held if (n, int(x.removeprefix("bucket="))) not in named]
            for path in [f"{self.path}/data/{name}"] if len(gone) == len(held) else [f"{self.path}/data/{name}/{x}" for x in gone]:
                fs, p = self._fs(path)
                fs.delete(p, True)
        for v in known[:-2]:
            fs, p = self._fs(f"{self.path}/versions/{v}.json")
            fs.delete(p, False)
