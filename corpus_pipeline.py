"""The corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that its predecessor
kept. Between stages the documents are written as Parquet and read again.

Null and empty texts pass every filter as texts without words. Equal rows are one document
to the stages that compare documents; rows that repeat a doc_id with differing texts are
edited each by itself, but stay or go together in near-dedup. A null doc_id is scored and
packed, and otherwise left as it is. Empty tables give empty results; all columns of
documents are kept until the last stage, and n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from folio.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from folio.llm.queries import table, tokenizer
from folio.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the rejection threshold, by a tagger fitted on the labelled ones among them; without labels all stay."""
    return toxicity.reject(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches; a document may lose all of its lines."""
    return line_dedup.dedup(docs, Scratch(spark))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that of the smallest doc_id; those without words are no group."""
    return near_dedup.dedup(docs, Scratch(spark))


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages of 50 words or more that earlier documents hold."""
    return substring_dedup.dedup(docs, Scratch(spark))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document and its place in a sequence; an empty text is a piece of the end id."""
    return packing.pack_all(docs, tokenizer("word_bpe_49k.json"), Scratch(spark))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_passages),
    ("packing", pack),
]

#: A fitted tagger, MinHash and a tokenizer are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
