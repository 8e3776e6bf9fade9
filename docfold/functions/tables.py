"""Table functions for SQL: chunkers and sheet rows, one text in, rows out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class ChunkFixed:
    """``chunk_fixed(text, size, overlap)``."""

    def eval(self, text: str, size: int, overlap: int):
        if not 0 <= overlap < size:
            raise ValueError("0 <= overlap < size is required")
        for n, at in enumerate(range(0, len(text or ""), size - overlap)):
            yield n, text[at : at + size]
            if at + size >= len(text):
                break


@F.udtf(returnType="chunk_index int, content string", useArrow=True)
class ChunkRecursive:
    """``chunk_recursive(text, profile)``."""

    def eval(self, text: str, profile: str):
        from docfold.operators.chunking import PROFILES, recursive_split

        yield from enumerate(recursive_split(text or "", PROFILES[profile]))


@F.udtf(returnType="row_no int, cells array<string>", useArrow=True)
class SheetRows:
    """``sheet_rows(content)``: rows with some cell that isn't blank."""

    def eval(self, content: str):
        import csv
        import io

        n = 0
        for row in csv.reader(io.StringIO(content or "", newline="")):
            if any(c.strip() for c in row):
                n += 1
                yield n, row


FUNCTIONS = {"chunk_fixed": ChunkFixed, "chunk_recursive": ChunkRecursive, "sheet_rows": SheetRows}


def register_table_functions(spark: SparkSession) -> None:
    """Makes the functions known to SQL: ``SELECT ... FROM docs, LATERAL chunk_recursive(text, 'rag')``.

    A text is cut where it lies: nothing is shuffled, and null or empty texts give no rows.
    """
    for name, f in FUNCTIONS.items():
        spark.udtf.register(name, f)
