"""Conversion as a column and an operator: errors, nulls, clashing names, plans and streams."""

import pytest
from pyspark.sql import functions as F

from folio import samples as s
from folio.operators.convert import convert_and_split, convert_documents, converted, golden_json
from folio.operators.split import split_documents
from folio.plans.splitting import Options
from folio.sources.base import Corrupt, Document, Limits
from folio.sources.formats import all_formats
from folio.streaming.flow import chunk_stream, file_stream, write_chunks


def rows_of(spark):
    pdf = s.pdf_file([[(24, 72, 700, "Title"), (12, 72, 650, "Body of the text.")]])
    rows = [
        (1, "a.txt", b"plain\r\ntext", "m"), (2, "b.PDF", pdf, "m"), (3, "c.docx", b"none", "m"), (4, "d.xyz", b"x", "m"), (5, None, b"x", "m"), (6, "e.md", None, "m"),
        (7, "f.csv", b'a"b', "m"), (8, "g.txt", b"", "m"), (9, "long.json", b"1" * 100, "m"), (None, "a.txt", b"again", None), (1, "a.txt", b"plain\r\ntext", "m"),
    ]
    return spark.createDataFrame(rows, "id long, name string, content binary, markdown string")


def test_conversion_of_mixed_rows(spark):
    docs = rows_of(spark)
    out = convert_documents(docs, name="name", registry=all_formats(json={"limits": Limits(source=99)}))
    assert out.columns == ["id", "name", "doc_markdown", "markdown", "sections", "error"] and out.count() == docs.count()
    got = {r["id"]: r for r in out.collect()}
    assert got[1]["markdown"] == "plain\ntext" and got[1]["sections"] == [] and got[1]["error"] is None
    assert got[2]["markdown"] == "# Title\n\nBody of the text." and got[2]["sections"][0]["kind"] == "page" and got[2]["sections"][0]["end"] == 26
    errors = {k: (r["error"]["class"], r["error"]["limit"], r["error"]["max"]) for k, r in got.items() if r["error"]}
    assert errors == {3: ("corrupt", None, None), 4: ("unsupported", None, None), 5: ("unsupported", None, None), 7: ("corrupt", None, None), 9: ("too_large", "source", 99)}
    assert all(got[k]["markdown"] is None for k in errors) and got[6]["markdown"] is None and got[6]["error"] is None and got[8]["markdown"] == ""
    assert got[3]["error"]["message"].startswith("c.docx: ")
    assert convert_documents(docs.limit(0), name="name").count() == 0


def test_own_converters(spark):
    def shout(source, limits):
        if source.data == b"bad":
            raise Corrupt("bad")
        return Document(source.data.decode().upper())

    registry = all_formats().register(shout, "txt", "loud")
    docs = spark.createDataFrame([("hi", ".LOUD"), ("hi", "text"), ("bad", "loud"), ("hi", "md")], "content string, f string")
    assert [(r["markdown"], r["error"] and r["error"]["class"]) for r in convert_documents(docs, fmt="f", registry=registry).collect()] == [("HI", None), ("HI", None), (None, "corrupt"), ("hi", None)]


def test_unused_conversions_are_pruned(spark):
    docs = rows_of(spark).withColumn("d", converted("content", name="name"))
    plan = docs.where("id > 3").select("id")._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEval" not in plan and "Python" not in plan


def test_convert_and_split_equals_both_steps(spark):
    docs = rows_of(spark).select("id", "name", "content")
    options = Options(12, 2)
    whole = split_documents(convert_documents(docs, name="name").where("markdown <> ''"), options, text="markdown", keep=["id"])
    once = convert_and_split(docs, options, name="name")
    assert once.columns[:3] == ["id", "name", "chunk_no"] and once.columns[-1] == "sections"
    cols = ["id", "chunk_no", "text", "start", "end", "length"]
    assert sorted(map(repr, once.select(cols).collect())) == sorted(map(repr, whole.select(cols).collect()))
    assert all(len(r["sections"]) == (r["id"] == 2) for r in once.collect())


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "one two three", "kept", 5, 6)], "doc_id long, body string, text string, start int, chunk_no int")
    out = split_documents(docs, Options(8), text="body", keep=["doc_id", "text", "start", "chunk_no"])
    assert out.columns[:5] == ["doc_id", "doc_text", "doc_start", "doc_chunk_no", "chunk_no"]
    assert [(r["doc_text"], r["text"]) for r in out.collect()][0] == ("kept", "one two ")
    assert split_documents(docs.limit(0), Options(8), text="body").count() == 0


def test_golden_json_leaves_out_empty_contexts(spark):
    docs = spark.createDataFrame([(1, "# h\n\none two three four five")], "doc_id long, text string")
    lines = [r["value"] for r in golden_json(split_documents(docs, Options(16))).collect()]
    assert lines[0].startswith('{"Start":0,"End":') and "Context" not in lines[0] and '"Context":"h"' in lines[1]


@pytest.mark.parametrize("batches", [1, 2])
def test_files_as_a_stream(spark, tmp_path, batches):
    for k in range(4):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"f{k}.csv").write_text(f"k,v\n{k},x\n")
    files = file_stream(spark, f"{tmp_path}/in", at_once=4 // batches, pattern="*.csv")
    chunks = chunk_stream(files, Options(200))
    write_chunks(chunks, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    (tmp_path / "in" / "f9.csv").write_text("k\n9\n")
    write_chunks(chunk_stream(file_stream(spark, f"{tmp_path}/in", pattern="*.csv"), Options(200)), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted(r["text"] for r in got.collect()) == sorted([*(f"| k | v |\n| --- | --- |\n| {k} | x |" for k in range(4)), "| k |\n| --- |\n| 9 |"])
    assert got.where(F.col("path").endswith("f9.csv")).count() == 1
