"""Near-duplicate documents: banded MinHash with odd sketches, confirmed on full shingle sets.

1. One pass gives each document its shingle count, a 128-bit key of its shingle set, 128
   MinHash values folded into 32 band keys of 4 rows, and an odd sketch of 512 bits: the
   parity bitmap of the samples, whose XOR population count with another's estimates a
   high similarity precisely. At a similarity of 0.75 a pair shares no band with a
   probability of 5e-6.
2. Documents of equal sets become one class, by partial aggregation.
3. In each bucket of a band, all classes are compared with the one that has the most
   bucket mates; the sketch drops pairs far below the threshold, full sets confirm.
4. Where a bucket still holds several components, its remaining pairs across components
   are compared by sketch in NumPy blocks, and the likely ones confirmed in place. So no
   group's pairs are written out, and no link between components of a bucket is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import links
from folio.llm.scratch import Scratch
from folio.llm.text import binary_column, hashed, mix, set_key, shingles, slices

SAMPLES, BANDS, BITS = 128, 32, 512
ROWS = SAMPLES // BANDS
#: Pairs whose sketches estimate less are dropped unconfirmed; five standard deviations below 0.75.
DOUBTFUL = 0.55

_U = np.uint64
_A = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
_B = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F))
_CHUNK = 1 << 15


def minhash(sets: list[np.ndarray]) -> np.ndarray:
    """SAMPLES minima for each of the sets, none empty."""
    out = np.empty((len(sets), SAMPLES), np.uint64)
    i = 0
    while i < len(sets):
        j, size = i, 0
        while j < len(sets) and (j == i or size + len(sets[j]) <= _CHUNK):
            size += len(sets[j])
            j += 1
        flat = np.concatenate(sets[i:j])
        at = np.cumsum([0, *(len(s) for s in sets[i : j - 1])])
        work = np.empty_like(flat)
        for k in range(SAMPLES):
            np.multiply(flat, _A[k], out=work)
            np.bitwise_xor(work, _B[k], out=work)
            out[i:j, k] = np.minimum.reduceat(work, at)
        i = j
    return out


def bands(minima: np.ndarray) -> np.ndarray:
    """One key for each band of each row."""
    h = np.zeros((len(minima), BANDS), np.uint64)
    for r in range(ROWS):
        h = mix(h + minima[:, r::ROWS])
    return mix(h + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def odd_sketch(minima: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits, as words of 64: sample k flips the bit that its minimum hashes to."""
    bit = (mix(minima + np.arange(SAMPLES, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) % _U(BITS)).astype(np.int64)
    flips = np.zeros((len(minima), BITS), np.uint8)
    np.add.at(flips, (np.arange(len(minima))[:, None], bit), 1)
    return np.packbits(flips & 1, axis=1, bitorder="little").view(np.uint64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a with each row of b, from the population count of their XOR."""
    odd = np.bitwise_count(a ^ b).sum(-1).astype(float)
    differ = -BITS / 2 * np.log(np.maximum(1 - 2 * odd / BITS, 1e-9))
    return 1 - differ / (2 * SAMPLES)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return estimate(a, b) >= DOUBTFUL


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, k1, k2, bands, sketch; the last four null for a document without words."""
    schema = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [np.unique(shingles(h)) for h in hashed(binary_column(part, "text"))]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys: list = [(None, None)] * len(sets)
            band: list = [None] * len(sets)
            sketch: list = [None] * len(sets)
            if full:
                minima = minhash([sets[k] for k in full])
                for k, b, o in zip(full, bands(minima), odd_sketch(minima)):
                    keys[k], band[k], sketch[k] = set_key(sets[k]), b, o.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([len(s) for s in sets], pa.int64()), *(pa.array([k[x] for k in keys], pa.int64()) for x in (0, 1)), pa.array(band, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, wanted: links.Slots) -> DataFrame:
    """(id, items) of each document that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            part = part.filter(pa.array(wanted.has(part.column(0).to_numpy())))
            sets = [np.unique(shingles(h)).tobytes() for h in hashed(binary_column(part, "text"))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["id", "items"])

    return docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(run, "id long, items binary")


def near_links(docs: DataFrame, sig: DataFrame, classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) of the class representatives that have a link."""
    entries = classes.select(F.col("rep.doc_id").alias("id"), "rep.sketch", F.posexplode("rep.bands").alias("nth", "bucket"))
    shared = entries.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    met = scratch.save(entries.select("id", "nth", "bucket").join(shared, "bucket"), "met")
    mates = met.groupBy("id").agg(F.sum("n").alias("mates"))
    centre = met.join(mates, "id").groupBy("bucket").agg(F.max_by("id", F.struct("mates", -F.col("id"))).alias("centre"))
    star = scratch.save(met.join(centre, "bucket").where("id <> centre").select("id", "centre").distinct(), "star")
    sketches = scratch.save(only_sketches(classes, met), "sketches")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(c.to_pylist()), np.uint64).reshape(batch.num_rows, -1) for c in batch.columns[2:])
                yield batch.select([0, 1]).filter(pa.array(likely(x, y)))

    uses = star.groupBy("centre").agg(F.count("*").alias("n"))
    centres = scratch.save(sketches.select(F.col("id").alias("centre"), F.col("sketch").alias("theirs")).join(uses, "centre"), "centres")
    both = links.hot_join(star.join(sketches.select("id", "sketch"), "id"), centres, ["centre"])
    tried = both.select("id", "centre", "sketch", "theirs").mapInArrow(near, "id long, centre long")
    tried = scratch.save(tried.select(F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct(), "tried")
    wanted = links.slots(met.select("id").distinct())
    sets = scratch.save(shingle_sets(docs, wanted).groupBy("id").agg(F.min("items").alias("items")), "sets")
    found = links.verified(tried, sets, scratch)
    group = links.components(found, scratch)
    open_ = met.join(group, "id", "left").withColumn("grp", F.coalesce("component", "id")).select("bucket", "nth", "id", "grp", "n")
    mixed = open_.groupBy("bucket").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("bucket")
    rest = open_.where("n > 2").join(mixed, "bucket").join(sketches.join(sets, "id"), "id").select("bucket", "nth", "id", "grp", "sketch", "bands", "items", "n")
    more = scratch.save(links.block_links(rest, likely), "more")
    return links.joined_up(group, more, scratch)


def only_sketches(classes: DataFrame, met: DataFrame) -> DataFrame:
    return classes.select(F.col("rep.doc_id").alias("id"), "rep.sketch", "rep.bands").join(met.select("id").distinct(), "id")


def groups(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable), kept.

    A document without words (null, empty or white space) is linked with nothing. A null
    doc_id is linked with nothing, has a null component_id and is kept. Rows that repeat a
    doc_id are one document: their links add up and they stay or go together. An empty
    table gives no rows; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    sig = scratch.save(signatures(docs), "signatures")
    known = sig.where("n_shingles > 0 and doc_id is not null")
    classes = scratch.save(known.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "bands", "sketch")).alias("rep"), F.count("*").alias("n")), "classes")
    label = near_links(docs, sig, classes, scratch)
    of_class = classes.select("k1", "k2", "n", F.col("rep.doc_id").alias("id")).join(label, "id", "left").select("k1", "k2", "n", F.coalesce("component", "id").alias("component"))
    own = links.hot_join(sig.select("doc_id", "n_shingles", "k1", "k2"), scratch.save(of_class, "of_class"), ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return own.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents of which one of each group stays (that of the smallest doc_id), with all their columns.

    Rows that repeat a doc_id stay or go together; a null doc_id stays. Only rows that may
    go are shuffled.
    """
    gone = scratch.save(groups(docs, scratch).where(~F.col("kept")).select("doc_id").distinct(), "gone")
    touched, rest = links.parted(docs, gone)
    return touched.join(gone.hint("merge"), "doc_id", "left_anti").union(rest)
