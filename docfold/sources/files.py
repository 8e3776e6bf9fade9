"""Raw files: reading, validation, text extraction, and spreadsheet rows."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import bounded_batches
from ..functions.text import clean_book_text, html_to_text, sanitize_keep_format
from . import uploads

MB = 1024 * 1024
TYPES = {"pdf": "pdf", "txt": "txt", "md": "md", "markdown": "md", "docx": "docx", "epub": "epub"}


def file_type(name: Column | str) -> Column:
    """Type by the last extension, case-insensitive; null if it isn't supported."""
    name = F.col(name) if isinstance(name, str) else name
    ext = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    out = F.lit(None).cast("string")
    for k, v in TYPES.items():
        out = F.when(ext == k, v).otherwise(out)
    return out


def read_files(spark: SparkSession, path: str, content: bool = True, max_bytes: int | None = None) -> DataFrame:
    """``name, file_type, size, content`` of the files under a path, files without a byte included.

    Without ``content`` no file is opened; content of more than ``max_bytes`` isn't read and is null.
    """
    uploads.register(spark)
    limit = {} if max_bytes is None else {"maxBytes": str(max_bytes)}
    raw = spark.read.format("uploads").options(content=str(content).lower(), **limit).load(path)
    return raw.select("name", file_type("name").alias("file_type"), "size", *(["content"] if content else []))


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """``name, entry_no, entry, size, content, error``: a row for each entry of an archive, one for any other file."""
    uploads.register(spark)
    return spark.read.format("uploads").option("entries", "true").load(path).select("name", "entry_no", "entry", "size", "content", "error")


def validate_files(files: DataFrame, max_bytes: int = 15 * MB, blob_bytes: int = int(4.5 * MB)) -> DataFrame:
    """Adds ``reason`` (null: accepted) and ``needs_blob``.  ``content`` is judged where there is such a column."""
    reason = F.when(F.col("size") > max_bytes, f"File size exceeds {max_bytes // MB}MB limit").when(F.col("file_type").isNull(), "Unsupported file type").when(F.col("size") == 0, "No text content found")
    if "content" in files.columns:
        head = F.substring("content", 1, 4)
        reason = reason.when((F.col("file_type") == "epub") & ((F.col("size") < 4) | (F.substring("content", 1, 2) != F.lit(b"PK"))), "Invalid EPUB file").when((F.col("file_type") == "pdf") & (head != F.lit(b"%PDF")), "Invalid PDF file")
    return files.withColumn("reason", reason).withColumn("needs_blob", F.col("reason").isNull() & (F.col("size") > blob_bytes))


def validate_attachments(files: DataFrame, max_bytes: int = 50 * MB) -> DataFrame:
    """S2, attachment profile: JPEG and PNG images of limited size."""
    reason = F.when(F.col("size") > max_bytes, f"File size should be less than {max_bytes // MB}MB").when(~F.coalesce(F.col("content_type").isin("image/jpeg", "image/png"), F.lit(False)), "File type should be JPEG or PNG")
    return files.withColumn("reason", reason)


_EXTRACTED = T.StructType([T.StructField("name", T.StringType()), T.StructField("file_type", T.StringType()), T.StructField("raw_text", T.StringType()), T.StructField("error", T.StringType())])


def _entries(content: bytes, kind: str) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        if kind == "docx":
            xml = z.read("word/document.xml").decode("utf-8", "replace")
            return ["\n\n".join(unescape("".join(re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>", p))) for p in re.split(r"</w:p>", xml) if "<w:t" in p)]
        names = [i for i in z.infolist() if re.search(r"\.(xhtml|html|htm)$", i.filename, re.I)]
        names = names or [i for i in z.infolist() if i.file_size > 100 and not re.search(r"meta-inf|\.(css|js|png|jpe?g|gif|svg)$|mimetype", i.filename, re.I)]
        out = []
        for i in names:
            try:
                out.append(z.read(i).decode("utf-8", "replace"))
            except Exception:  # noqa: BLE001  a damaged entry is skipped; the file fails if none is left
                continue
        return out


def _extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for name, kind, content in zip(b["name"], b["file_type"], b["content"]):
            try:
                parts = [content.decode("utf-8", "replace")] if kind in ("txt", "md") else _entries(content, kind)
                if not parts:
                    raise ValueError("no readable entry")
                # Entries stay apart until their markup is gone.
                rows.append((name, kind, "\x1e".join(parts), None))
            except Exception as e:  # noqa: BLE001  a bad file becomes a reject, not a failed job
                rows.append((name, kind, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(rows, columns=["name", "file_type", "raw_text", "error"])


def extract_text(files: DataFrame) -> DataFrame:
    """S3: ``name, file_type, text, error``.  Files are dealt evenly first, as their sizes differ much, and read in bounded batches.

    PDF bytes aren't parsed here: give their text as txt and repair it with ``repair_spaced_letters``.
    """
    bounded_batches(files.sparkSession)
    raw = files.select("name", "file_type", "content").repartition(files.sparkSession.sparkContext.defaultParallelism * 4).mapInPandas(_extract, _EXTRACTED)
    parts = F.filter(F.transform(F.split("raw_text", "\x1e"), lambda x: html_to_text(x)), lambda x: x != "")
    book = clean_book_text(F.array_join(parts, "\n\n"))
    text = F.when(F.col("file_type") == "epub", book).otherwise(sanitize_keep_format("raw_text"))
    return raw.select("name", "file_type", F.when(F.col("error").isNull(), text).alias("text"), "error")


LETTERS = [chr(65 + k) for k in range(26)]


def sheet_cells(content: Column | str) -> Column:
    """Rows of cells of a CSV text, without rows whose cells are all blank; quoted cells may hold commas and line ends."""

    @F.pandas_udf("array<array<string>>")
    def cells(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [r for r in csv.reader(io.StringIO(t or "", newline="")) if any(x.strip() for x in r)])

    return cells(F.col(content) if isinstance(content, str) else content)


def clean_sheet_rows(sheets: DataFrame, pad_rows: int | None = None) -> DataFrame:
    """``id, row_no, A..Z, cells`` from CSV text in ``content``.

    Empty lines and rows whose cells are all blank go; ``cells`` holds all cells of a row, also those past Z.
    Missing cells of A..Z are null, or '' when rows are padded to ``pad_rows``; padding adds rows without cells.
    """
    rows = sheets.select("id", sheet_cells("content").alias("rows"))
    if pad_rows is not None:
        more = F.greatest(F.lit(pad_rows) - F.size("rows"), F.lit(0))
        rows = rows.withColumn("rows", F.concat("rows", F.array_repeat(F.array().cast("array<string>"), more)))
    kept = rows.select("id", F.posexplode("rows").alias("row_no", "cells")).withColumn("row_no", F.col("row_no") + 1)
    missing = F.lit(None if pad_rows is None else "")
    return kept.select("id", "row_no", *[F.coalesce(F.get("cells", F.lit(k)), missing).alias(x) for k, x in enumerate(LETTERS)], "cells")


def write_files(files: DataFrame, folder: str) -> None:
    """One file for each row of ``name, content`` in a folder that all executors see, written within tasks.

    Names must differ; a task that runs again writes the same files again.
    """

    def write(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for b in rows:
            for name, content in zip(b["name"], b["content"]):
                where, path = fs.FileSystem.from_uri(f"{folder if '://' in folder or folder.startswith('file:') else 'file://' + folder}/{name}")
                where.create_dir(path.rpartition("/")[0], recursive=True)
                with where.open_output_stream(path) as out:
                    out.write(bytes(content))
            yield pd.DataFrame({"n": [len(b)]})

    files.select("name", "content").mapInPandas(write, "n long").agg(F.sum("n")).collect()
