"""Column functions and operators on Spark."""

import pytest
from pyspark.sql import functions as F

from folio.functions import text as fn
from folio.operators.split import register, split_documents
from folio.plans.splitting import Options


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


@pytest.mark.parametrize("name, want", [(" .HTM ", "html"), ("Markdown", "md"), ("yml", "yaml"), ("text", "txt"), ("pdf", "pdf"), ("", "")])
def test_format_name(spark, name, want):
    assert one(spark, name, fn.format_name) == want


@pytest.mark.parametrize("path, want", [("a/b.PDF", "pdf"), ("a.b/c", None), (".hidden", None), ("x.", None), ("d\\e.htm", "html"), ("a.tar.md", "md")])
def test_format_of(spark, path, want):
    assert one(spark, path, fn.format_of) == want


def test_normalized(spark):
    assert one(spark, "﻿a\r\nb\rc\0﻿", fn.normalized) == "a\nb\nc﻿"


@pytest.mark.parametrize("text, want", [("", "```json\n```"), ("x", "```json\nx\n```"), ("x\n", "```json\nx\n```"), ("a ```` b", "`````json\na ```` b\n`````")])
def test_fenced(spark, text, want):
    assert one(spark, text, lambda c: fn.fenced(c, "json")) == want


def test_cells_and_paragraphs(spark):
    assert one(spark, " a|b\\　\n c\0 ", fn.cell) == "a\\|b\\\\ c"
    assert one(spark, "  # a\r\n1. b\n12345678901. c\nd", fn.paragraph) == "\\# a\n1\\. b\n12345678901. c\nd"


def test_tables(spark):
    rows = [["a", "b|"], ["", " "], ["1"], ["2", "x", "y"]]
    want = "| a | b\\| |  |\n| --- | --- | --- |\n| 1 |  |  |\n| 2 | x | y |"
    assert one(spark, rows, fn.gfm_table, "array<array<string>>") == want
    assert one(spark, rows, fn.gfm_table_size, "array<array<string>>") == len(want)
    assert one(spark, [], fn.gfm_table, "array<array<string>>") == "" and one(spark, [], fn.gfm_table_size, "array<array<string>>") == 0


@pytest.mark.parametrize("a, b, want", [(0, 4, [1]), (6, 9, [2]), (3, 7, [1, 2]), (7, 7, []), (30, 40, []), (0, 99, [1, 2, 4])])
def test_sections_in(spark, a, b, want):
    s = [(1, 0, 4), (2, 6, 9), (3, 9, 9), (4, 11, 30)]
    got = one(spark, s, lambda c: fn.sections_in(c, F.lit(a), F.lit(b)), "array<struct<number: int, start: int, end: int>>")
    assert [x["number"] for x in got] == want


def test_split_documents(spark):
    df = spark.createDataFrame([(1, "# T\n\nbody " * 30, "x"), (2, None, "y"), (3, "  ", "z")], "doc_id long, text string, lang string")
    out = split_documents(df, Options(40, 5), keep=["doc_id", "lang"])
    rows = out.orderBy("chunk_no").collect()
    assert {r["doc_id"] for r in rows} == {1} and [r["chunk_no"] for r in rows] == list(range(len(rows)))
    plan = out.where("lang = 'x'")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_sql_table_function(spark):
    register(spark)
    spark.createDataFrame([(1, "one two three four five six")], "id int, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, c.text FROM texts, LATERAL md_split(t, 10, 0, 0) c ORDER BY c.start").collect()
    assert "".join(r["text"] for r in rows) == "one two three four five six"


def test_fence_length_reads_whole_texts(spark, tmp_path):
    from folio.queries import fence_length

    texts = [(6, "x" * 60 + " ````` y"), (12, "`" * 50 + "z"), (2, "plain")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"]: r["fence"] for r in fence_length(spark, str(tmp_path)).collect()} == {6: 6, 12: 51, 2: 3}
