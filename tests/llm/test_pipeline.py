"""The pipeline against its operators, and against plain Python where that is short."""

import corpus_pipeline
import __spark_entry__
from folio.llm import queries


def test_stages_follow_one_another(spark, tmp_path):
    spark.conf.set("folio.scratch.dir", f"file://{tmp_path}")
    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    names, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).cache()
        assert docs.columns == names
        n = docs.count()
        assert n <= kept and (n == kept or name in ("toxicity", "near_dedup"))
        kept = n
        assert docs.where("n_chars <> length(text)").count() == 0
    whole = corpus_pipeline.run(spark, sf).collect()
    assert len({r["doc_id"] for r in whole}) == kept
    assert "pipeline" in __spark_entry__.queries()
    spark.conf.unset("folio.scratch.dir")


def test_empty_tables(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
