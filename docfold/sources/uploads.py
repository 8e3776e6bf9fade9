"""Uploaded files as a data source for batches and streams: ``spark.read.format("uploads")`` after :func:`register`."""

from __future__ import annotations

import time
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, entry_no int, entry string, size long, modified timestamp, content binary, error string"
ARCHIVES = (".epub", ".docx", ".zip")
BATCH_BYTES = 8 << 20
#: Bytes of an archive without an entry.
SHORTEST_ARCHIVE = 22


@dataclass
class Files(InputPartition):
    """Files that one task reads: (time of change in ns, path, bytes)."""

    files: list[tuple[int, str, int]]


class Folder:
    """What both readers share: the listing, its division among tasks, and the reading of one part."""

    def __init__(self, options: dict[str, str]) -> None:
        if "path" not in options:
            raise ValueError("uploads need a path")
        self.root = options["path"]
        self.partition_bytes = int(options.get("partitionBytes", 64 << 20))
        self.max_bytes = int(options.get("maxBytes", 1 << 30))
        self.with_content = options.get("content", "true").lower() == "true"
        self.entries = options.get("entries", "false").lower() == "true"

    def system(self) -> tuple[fs.FileSystem, str]:
        has_scheme = "://" in self.root or self.root.startswith("file:")
        return fs.FileSystem.from_uri(self.root if has_scheme else f"file://{self.root}")

    def list(self, missing_ok: bool) -> list[tuple[int, str, int]]:
        """Files under the path, without those that begin with a dot or an underscore, in order of time and path."""
        system, base = self.system()
        if system.get_file_info(base).type == fs.FileType.File:
            found = [system.get_file_info(base)]
        else:
            found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=missing_ok))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")

    def divide(self, files: list[tuple[int, str, int]]) -> list[Files]:
        """Runs of files of about ``partitionBytes``; each file counts 4 KB besides, so that small ones spread too."""
        out: list[Files] = []
        room = 0
        for f in files:
            cost = min(f[2], self.max_bytes) + 4096
            if not out or room < cost:
                out.append(Files([]))
                room = self.partition_bytes
            out[-1].files.append(f)
            room -= cost
        return out

    def rows(self, part: Files) -> Iterator[tuple]:
        system, _ = self.system()
        for ns, path, size in part.files:
            head = (path, path.rpartition("/")[2])
            when = ns // 1000
            if self.entries and path.lower().endswith(ARCHIVES):
                try:
                    if size < SHORTEST_ARCHIVE:
                        raise zipfile.BadZipFile("File is not a zip file")
                    # Entries are read one by one, so an archive is never held whole.
                    with system.open_input_file(path) as f, zipfile.ZipFile(f) as z:
                        for k, entry in enumerate(i for i in z.infolist() if not i.is_dir()):
                            fits = self.with_content and entry.file_size <= self.max_bytes
                            try:
                                row = (z.read(entry) if fits else None, None)
                            except Exception as e:  # noqa: BLE001  a damaged entry is told, the others are read
                                row = (None, f"{type(e).__name__}: {e}")
                            yield (*head, k, entry.filename, entry.file_size, when, *row)
                except (zipfile.BadZipFile, ValueError, NotImplementedError) as e:  # damage; storage that fails isn't
                    yield (*head, None, None, size, when, None, f"BadZipFile: {e}")
                continue
            content = None
            if self.with_content and size <= self.max_bytes:
                with system.open_input_stream(path) as f:
                    content = f.read()
            yield (*head, None, None, size, when, content, None)

    def batches(self, part: Files, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for row in self.rows(part):
            rows.append(row)
            held += len(row[6] or b"") + 256
            if held >= BATCH_BYTES:
                yield _batch(rows, schema)
                rows, held = [], 0
        if rows:
            yield _batch(rows, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _arrow_schema() -> pa.Schema:
    text, whole = pa.string(), pa.int64()
    return pa.schema([("path", text), ("name", text), ("entry_no", pa.int32()), ("entry", text), ("size", whole), ("modified", pa.timestamp("us", "UTC")), ("content", pa.binary()), ("error", text)])


class UploadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)

    def partitions(self) -> list[InputPartition]:
        return self.folder.divide(self.folder.list(missing_ok=False)) or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition, _arrow_schema())


class UploadStream(DataSourceStreamReader):
    """The offset is the latest time of change that has been taken, so it doesn't grow with the files.

    Files are taken once they are ``settle`` seconds old: storage whose times are coarse, or that shows a file
    a little after its time, loses none.  A batch that runs again lists the same span of time.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.folder = Folder(options)
        self.settle = int(float(options.get("settle", 2)) * 1e9)

    def initialOffset(self) -> dict:
        return {"taken": -1}

    def latestOffset(self) -> dict:
        until = time.time_ns() - self.settle
        return {"taken": max((f[0] for f in self.folder.list(missing_ok=True) if f[0] <= until), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.folder.divide([f for f in self.folder.list(missing_ok=True) if start["taken"] < f[0] <= end["taken"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.folder.batches(partition, _arrow_schema())


class UploadSource(DataSource):
    """One row for each file under ``path``, files without a byte included.

    Options: ``partitionBytes`` a task reads (64 MB), ``maxBytes`` of a content that is read (1 GB; longer ones are
    null), ``content`` (false: names and sizes only, no file is opened), ``entries`` (true: a row for each entry
    of an archive; one that can't be opened is a row with ``error``), and for streams ``settle``.
    """

    @classmethod
    def name(cls) -> str:
        return "uploads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return UploadReader(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return UploadStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(UploadSource)
