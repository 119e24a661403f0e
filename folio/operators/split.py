"""The splitter as a DataFrame operator, a column and a SQL table function."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folio.plans.splitting import Options, split

_HEADING = "struct<level: int, text: string, start: int, end: int>"
CHUNK = f"struct<text: string, start: int, end: int, length: int, headings: array<{_HEADING}>, table_header: struct<text: string, start: int, end: int>>"
FIELDS = ["text", "start", "end", "length", "headings", "table_header"]
_PLACE = [("start", pa.int32()), ("end", pa.int32())]
_TYPES = [
    ("text", pa.string()), *_PLACE, ("length", pa.int32()),
    ("headings", pa.list_(pa.struct([("level", pa.int32()), ("text", pa.string()), *_PLACE]))),
    ("table_header", pa.struct([("text", pa.string()), *_PLACE])),
]


def chunk_array(rows: list[list[dict] | None], *extra: tuple[str, pa.DataType]) -> pa.Array:
    """An Arrow array of lists of chunks; null for no list."""
    flat = [c for r in rows if r for c in r]
    fields = [*_TYPES, *extra]
    values = pa.StructArray.from_arrays([pa.array([c[k] for c in flat], t) for k, t in fields], fields=[pa.field(k, t) for k, t in fields])
    offsets, at = [], 0
    for r in rows:
        offsets.append(None if r is None else at)
        at += len(r or ())
    return pa.ListArray.from_arrays(pa.array([*offsets, at], pa.int32()), values)


def chunks_of(text: Column | str, options: Options) -> Column:
    """array<chunk> of a text; a null gives null, white space alone an empty array.

    A deterministic scalar: filters pass below it, and unused it is pruned away.
    """

    @F.arrow_udf(f"array<{CHUNK}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield chunk_array([None if t is None else split(t, options) for t in batch.to_pylist()])

    return run(text)


def exploded(docs: DataFrame, chunks: Column, keep: list[str], extra: list[str] = ()) -> DataFrame:
    """A row for each chunk. A kept column named like a chunk's field or chunk_no comes out with doc_ in front.

    The explode is an outer one, then the empty rows go: an inner explode of a Python
    column would have Catalyst evaluate it twice.
    """
    taken = {"chunk_no", *FIELDS, *extra}
    names = [f"doc_{c}" if c in taken else c for c in keep]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(keep, names)], chunks.alias("_chunks"))
    rows = rows.select(*names, F.posexplode_outer("_chunks").alias("chunk_no", "_chunk"))
    return rows.where(F.col("_chunk").isNotNull()).select(*names, "chunk_no", "_chunk.*")


def split_documents(docs: DataFrame, options: Options, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: the kept columns, chunk_no (from 0) and the chunk's fields."""
    return exploded(docs, chunks_of(F.col(text), options), keep or ["doc_id"])


def register(spark: SparkSession, name: str = "md_split") -> None:
    """A SQL table function name(text, size, overlap, max_size), for LATERAL."""

    class MdSplit:
        def eval(self, text: str, size: int, overlap: int, max_size: int):
            for i, c in enumerate(split(text or "", Options(size, overlap, max_size))):
                yield i, c["text"], c["start"], c["end"], c["length"]

    spark.udtf.register(name, F.udtf(MdSplit, returnType="chunk_no int, text string, start int, end int, length int"))


def chunk_type() -> T.DataType:
    return T._parse_datatype_string(CHUNK)
