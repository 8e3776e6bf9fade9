"""Table functions give the rows of the operators that they stand for."""

from conftest import DATA

from docfold.functions.tables import register_table_functions
from docfold.operators import chunking
from docfold.plans.registry import QUERIES
from docfold.sources import files
from docfold.sources.fixtures import Tables


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chunkers_from_sql(spark):
    t = Tables(spark, DATA)
    want = chunking.chunk_recursive(t.raw_text(), "rag").select("id", "chunk_index", "content")
    assert rows(QUERIES["c2_lateral_chunk_recursive"](spark, DATA)) == rows(want)
    assert rows(QUERIES["c1_lateral_chunk_fixed"](spark, DATA)) == rows(chunking.chunk_fixed(t.raw_text()))


def test_odd_texts(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, None), (2, ""), (3, "abc"), (4, "abcdefghij")], "id long, text string").createOrReplaceTempView("odd")
    got = rows(spark.sql("SELECT id, chunk_index, content FROM odd, LATERAL chunk_fixed(text, 4, 1)"))
    assert got == [(3, 0, "abc"), (4, 0, "abcd"), (4, 1, "defg"), (4, 2, "ghij")]
    assert spark.sql("SELECT * FROM odd, LATERAL chunk_recursive(text, 'plain')").count() == 2


def test_sheets_from_sql(spark):
    register_table_functions(spark)
    df = spark.createDataFrame([(1, 'a,b\n\n , \n"x, y\nz",w\n'), (2, ""), (3, None)], "id long, content string")
    df.createOrReplaceTempView("sheets")
    got = spark.sql("SELECT id, row_no, cells FROM sheets, LATERAL sheet_rows(content)")
    assert rows(got) == rows(files.clean_sheet_rows(df).select("id", "row_no", "cells"))
