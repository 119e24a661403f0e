"""Threshold-scaled document sketches: every shingle hash below a fixed fraction.

The retained sets merge by union and estimate containment between documents of very
unequal length. `neighbours` also sketches each document's edited text against the
next document in doc_id order: one shuffle of the texts into doc_id ranges, the first
document of each range also going to the end of the range before, so no window over
all rows and no second copy of the corpus is needed.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.recent import small_batches
from folio.llm.text import shingles, word_hashes

#: One of so many shingle hashes is retained, of short and long texts alike.
SCALE = 2
_KEEP = np.uint64((1 << 64) // SCALE)
#: Bytes of a retained value: the upper bits below the threshold.
WIDTH = 5
_SHIFT = np.uint64(64 - (SCALE - 1).bit_length() - 8 * WIDTH)


def retained(wh: np.ndarray) -> np.ndarray:
    """Sorted 40-bit values of the distinct shingle hashes below the threshold."""
    h = shingles(wh)
    return np.unique(h[h < _KEEP] >> _SHIFT)


def pack(sketch: np.ndarray) -> str:
    """Sorted values as base64 of WIDTH big-endian bytes each; empty for none."""
    return base64.b64encode(sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - WIDTH :].tobytes()).decode()


def unpack(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, WIDTH)
    return np.pad(raw, ((0, 0), (8 - WIDTH, 0))).copy().view(">u8").ravel().astype(np.uint64)


def merge(*sketches: np.ndarray) -> np.ndarray:
    """Sketch of the union of the documents."""
    return np.unique(np.concatenate(sketches))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the smaller shingle set that the other holds: 0 if either sketch is empty, as it says nothing then."""
    if not len(a) or not len(b):
        return 0.0
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def likeness(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> float:
    """Containment of two texts by their sketches a and b; where both are empty, 1 if the texts' word hashes x and y make equal shingle sets, else 0."""
    if not len(a) and not len(b):
        return float(np.array_equal(np.unique(shingles(x)), np.unique(shingles(y))))
    return containment(a, b)


def neighbours(docs: DataFrame, tasks: int | None = None) -> DataFrame:
    """One row per document: its sketch, its edited text's, and the likeness to that and to the next document.

    Next is by ascending doc_id, after the last the first; a null doc_id comes before all
    others; rows of one doc_id follow by text, a null text being empty. A lone document is
    its own next. A text with no retained hash has an empty fingerprint; of two such texts
    the likeness is 1 if their shingle sets are equal (as those of two texts without words
    are), else 0. Empty tables give no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = tasks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 100 * n).alias("q"), F.count_if(F.isnull("doc_id")).alias("nulls"), F.min("doc_id").alias("low")).first()
    cuts = sorted({x for x in ids["q"] or [] if x != ids["low"]})
    first = F.isnull("doc_id") if ids["nulls"] else F.col("doc_id") == F.lit(ids["low"])
    home = F.when(F.isnull("doc_id"), 0)
    if cuts:
        # A binary search over the cuts, at most a few thousand doc_ids.
        bounds = F.array(*[F.lit(c) for c in cuts])
        home = home.otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(cuts).bit_length()))), F.struct(F.lit(0).alias("a"), F.lit(len(cuts)).alias("b")), lambda s, _: F.when(s["a"] < s["b"], F.when(F.get(bounds, F.floor((s["a"] + s["b"]) / 2).cast("int")) <= F.col("doc_id"), F.struct((F.floor((s["a"] + s["b"]) / 2) + 1).cast("int").alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), F.floor((s["a"] + s["b"]) / 2).cast("int").alias("b")))).otherwise(s))["a"])
    else:
        home = home.otherwise(0)
    spots = F.array_compact(F.array(
        F.struct(F.col("home").alias("pid"), F.lit(0).alias("tail")),
        F.when((F.col("home") > 0) & F.col("doc_id").isin(cuts), F.struct((F.col("home") - 1).alias("pid"), F.lit(1).alias("tail"))),
        F.when(first, F.struct(F.lit(len(cuts)).alias("pid"), F.lit(1).alias("tail"))),
    ))
    rows = docs.withColumn("home", home).select("doc_id", "text", F.explode(spots).alias("s")).select("doc_id", "text", "s.pid", "s.tail")
    rows = rows.repartition("pid").sortWithinPartitions("pid", "tail", "doc_id", "text")
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prev = None  # (doc_id, text, word hashes, sketch, pid) that still lacks its next

        def pair(a, text: str, words: np.ndarray, sketch: np.ndarray) -> tuple:
            doc, own, x, mine, _ = a
            half = len(own) // 2
            edited = (own[: len(own) - half] + text[:half]).encode()
            y = word_hashes(edited)[0]
            es = retained(y)
            return doc, len(own), hashlib.sha256(edited).hexdigest(), pack(mine), pack(es), likeness(x, y, mine, es), likeness(x, words, mine, sketch)

        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part, out = batch.slice(i, 500), []
                for doc, text, pid, tail in zip(*(c.to_pylist() for c in part.columns)):
                    if prev is None and tail:
                        continue
                    words = word_hashes(text.encode())[0]
                    sketch = retained(words)
                    if prev is not None:
                        assert prev[4] == pid, "a range without the first row of the next"
                        out.append(pair(prev, text, words, sketch))
                    prev = None if tail else (doc, text, words, sketch, pid)
                cols = list(zip(*out)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in schema.split(", ")])
        assert prev is None, "a range without the first row of the next"

    small_batches(spark)
    return rows.mapInArrow(run, schema)
