"""Substring dedup: paragraph MinHash banding, exact verification, removal by components.

Repeated passages stand anywhere in a line, so paragraphs are cut where the content says:
between words at which a hash of the word and the next is the least within REACH words
on either side. A passage that two texts share is cut alike in both, but for its ends.

0. Documents of the same words as an earlier one are found by a digest, with partial
   aggregation, and go as a whole; the rest works on the first of each.
1. One pass gives each paragraph the sum of its shingle hashes and BANDS minima, each a
   band of one row: short paragraphs that share no 5-word shingle are never similar, so
   one row keeps false candidates few, and a pair of similarity 0.75 is missed with a
   probability of 1/64.
2. Equal paragraphs are classes, by partial aggregation. In each band's bucket, classes
   are compared with the first and with the next by hash; full sets confirm a similarity
   of 0.75; components of links join classes. Buckets of four classes or more that still
   hold several components are compared in blocks on full sets, so that no link between
   components of a bucket is missed.
3. In each component the earliest paragraph stays. Runs of later ones in a document,
   against one and the same earlier document, are stretched word by word as far as both
   texts agree. Stretched runs that overlap or touch make one passage, whatever earlier
   documents hold them; passages of LEAST words or more are removed.

A component that stays within one document is left alone. Texts are never moved: which
documents and paragraphs a pass has to look at is told by slot maps of fixed size (links).
Classes are keyed by a 64-bit sum; two that collide can only join paragraphs, and a
passage must be LEAST words long besides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm import links
from folio.llm.scratch import Scratch
from folio.llm.text import SHINGLE, binary_column, hashed, mix, set_key, shingles, slices

#: Words on either side within which a cut is the least; paragraphs have REACH + 1 words at least and twice that on average.
REACH = 6
BANDS = 3
#: Words of the shortest repeated passage that is removed.
LEAST = 50
#: Paragraphs of a run that may differ between two that are repeated.
GAP = 2

_U = np.uint64
_A = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def cuts(wh: np.ndarray) -> np.ndarray:
    """First words of the paragraphs of a text with words."""
    n = len(wh)
    if n < 2 * REACH + 2:
        return np.zeros(1, np.int64)
    v = mix(wh[:-1] * _U(0x9E3779B97F4A7C15) + wh[1:])
    w = np.lib.stride_tricks.sliding_window_view(v, 2 * REACH + 1)
    mid = w[:, REACH]
    inner = np.flatnonzero((mid == w.min(1)) & ((w == mid[:, None]).sum(1) == 1)) + REACH
    return np.concatenate([[0], inner]).astype(np.int64)


def _spans(starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes for reduceat, two for each paragraph: its first shingle, and one past its last."""
    total = max(1, n - SHINGLE + 1)
    ends = np.concatenate([starts[1:], [n]])
    last = np.minimum(np.maximum(ends - SHINGLE + 1, starts + 1), total)
    first = np.minimum(starts, last - 1)
    return first, last


def text_tag(raw: bytes) -> int:
    """63 bits of a text, which tell rows apart that repeat a doc_id with differing texts."""
    return xxhash.xxh64_intdigest(raw) >> 1


_DOC = "struct<doc_id: long, tag: long>"


def _docs(ids: pa.Array, tags: list[int]) -> pa.StructArray:
    return pa.StructArray.from_arrays([ids, pa.array(tags, pa.int64())], names=["doc_id", "tag"])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[tuple[pa.Array, list[bytes], list[int]]]:
    """(doc_ids, texts, tags) of some rows of (doc_id, text) at a time."""
    for part in slices(batches, rows):
        texts = binary_column(part, "text")
        yield part.column(0), texts, [text_tag(t) for t in texts]


def _chosen(ids: pa.Array, texts: list[bytes], tags: list[int], keep: np.ndarray) -> tuple[pa.Array, list[bytes], list[int]]:
    at = np.flatnonzero(keep).tolist()
    return ids.take(pa.array(at, pa.int64())), [texts[k] for k in at], [tags[k] for k in at]


def paragraphs(docs: DataFrame, copies: links.Slots | None = None, first: links.Slots | None = None) -> DataFrame:
    """doc, no, word, words, lo, hi, h (hash of the shingle set), m (minima) of each paragraph of the documents but known copies.

    lo and hi: from where to where the paragraph and its neighbours reach.
    """
    names = ["doc", "no", "word", "words", "lo", "hi", "h", *(f"m{b}" for b in range(BANDS))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tags in _parts(batches):
            if copies is not None:
                key = ids.to_numpy(), np.array(tags, np.int64)
                ids, texts, tags = _chosen(ids, texts, tags, ~copies.has(*key) | first.has(*key))
            cols: list[list] = [[] for _ in names]
            for k, wh in enumerate(hashed(texts)):
                if not len(wh):
                    continue
                s, starts = shingles(wh), cuts(wh)
                first_, last = _spans(starts, len(wh))
                idx = np.stack([first_, last], 1).ravel()
                ends = idx[-1] == len(s)
                idx = idx[:-1] if ends else idx
                cols[0].append(np.full(len(starts), k, np.int64))
                cols[1].append(np.arange(len(starts), dtype=np.int32))
                cols[2].append(starts.astype(np.int32))
                stops = np.concatenate([starts[1:], [len(wh)]])
                cols[3].append((stops - starts).astype(np.int32))
                cols[4].append(np.concatenate([[0], starts[:-1]]).astype(np.int32))
                cols[5].append(np.concatenate([stops[1:], [len(wh)]]).astype(np.int32))
                cols[6].append(mix(np.add.reduceat(s, idx)[::2]).view(np.int64))
                for b in range(BANDS):
                    cols[7 + b].append(mix(np.minimum.reduceat(s * _A[b], idx)[::2] + _U(b)).view(np.int64))
            if cols[0]:
                arrays = [pa.array(np.concatenate(c)) for c in cols]
                arrays[0] = _docs(ids, tags).take(arrays[0])
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc {_DOC}, no int, word int, words int, lo int, hi int, h long, " + ", ".join(f"m{b} long" for b in range(BANDS))
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def paragraph_sets(docs: DataFrame, wanted: links.Slots) -> DataFrame:
    """(id, items) of the paragraphs that may be wanted, by document and number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs_, texts, tags in _parts(batches):
            ids, items = [], []
            for doc, tag, wh in zip(docs_.to_pylist(), tags, hashed(texts)):
                if not len(wh):
                    continue
                starts = cuts(wh)
                n = len(starts)
                found = np.flatnonzero(wanted.has(np.full(n, doc), np.full(n, tag), np.arange(n)))
                if len(found):
                    s = shingles(wh)
                    first, last = _spans(starts, len(wh))
                    for k in found.tolist():
                        x = s[first[k] : last[k]]
                        ids.append(int(mix(x.sum(keepdims=True)).view(np.int64)[0]))
                        items.append(np.unique(x).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], names=["id", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "id long, items binary")


def _met(classes: DataFrame) -> DataFrame:
    """(key, first, before, h): each class of a bucket but its first, with the first and with the one before it, by hash."""
    keys = F.explode(F.array(*[F.col(f"m{b}") for b in range(BANDS)])).alias("key")
    rows = classes.select(keys, "h").repartition("key").sortWithinPartitions("key", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = before = None
        for batch in batches:
            if not batch.num_rows:
                continue
            k, h = (c.to_numpy() for c in batch.columns)
            new = np.concatenate([[key is None or k[0] != key], k[1:] != k[:-1]])
            where = np.maximum.accumulate(np.where(new, np.arange(len(k)), -1))
            start = np.where(where >= 0, h[where], first if first is not None else 0)
            prev = np.concatenate([[before if before is not None else 0], h[:-1]])
            key, first, before = k[-1], start[-1], h[-1]
            yield pa.RecordBatch.from_arrays([pa.array(c[~new]) for c in (k, start, prev, h)], names=["key", "first", "before", "h"])

    return rows.mapInArrow(run, "key long, first long, before long, h long")


def _candidates(met: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes in one bucket: each with the first, and with the one before it."""
    other = met.select("h", F.explode(F.array("first", "before")).alias("other")).where("h <> other")
    return other.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()


def _more_links(met: DataFrame, sets: DataFrame, group: DataFrame) -> DataFrame:
    """The links (a, b) that are left between components of a bucket; in one of three classes every pair has been tried."""
    large = met.groupBy("key").agg((F.count("*") + 1).alias("n"), F.min("first").alias("first")).where("n > 3")
    members = met.join(large.select("key", "n"), "key").select("key", "n", F.col("h").alias("id")).union(large.select("key", "n", F.col("first").alias("id")))
    own = members.join(group, "id", "left").select(F.col("key").alias("bucket"), "n", "id", F.coalesce("component", "id").alias("grp"))
    mixed = own.groupBy("bucket").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi").select("bucket")
    return links.prefix_links(own.join(mixed, "bucket").join(sets, "id"))


def word_rows(docs: DataFrame, wanted: links.Slots) -> DataFrame:
    """(doc, hashes): 32-bit hashes of the words, in order, of each document that may be wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tags in _parts(batches):
            ids, texts, tags = _chosen(ids, texts, tags, wanted.has(ids.to_numpy(), np.array(tags, np.int64)))
            rows = [(h >> _U(32)).astype("<u4").tobytes() for h in hashed(texts)]
            yield pa.RecordBatch.from_arrays([_docs(ids, tags), pa.array(rows, pa.binary())], names=["doc", "hashes"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc {_DOC}, hashes binary")


def _agree(x: np.ndarray, y: np.ndarray) -> int:
    """Leading values that are equal."""
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def digests(docs: DataFrame) -> DataFrame:
    """doc, n_words, k1, k2 (128-bit key of the words in order) of each document with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, tags in _parts(batches):
            rows = [(k, len(h), *set_key(h)) for k, h in enumerate(hashed(texts)) if len(h)]
            c = list(zip(*rows)) or [[]] * 4
            at, *rest = (pa.array(v, t) for v, t in zip(c, [pa.int64(), pa.int32(), pa.int64(), pa.int64()]))
            yield pa.RecordBatch.from_arrays([_docs(ids, tags).take(at), *rest], names=["doc", "n_words", "k1", "k2"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc {_DOC}, n_words int, k1 long, k2 long")


def whole_copies(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, links.Slots, links.Slots]:
    """(doc, n_words, kept) of the documents that one of a lesser doc_id equals word for word; a map of them, and one of the others that it seems to hold."""
    keys = scratch.save(digests(docs), "digests")
    groups = keys.groupBy("k1", "k2").agg(F.min("doc").alias("kept"), F.count("*").alias("n"), F.max("doc.doc_id").alias("last"))
    many = scratch.save(groups.where("kept.doc_id < last").drop("last"), "many")
    copies = links.hot_join(keys, many, ["k1", "k2"]).where("doc.doc_id <> kept.doc_id").select("doc", "n_words", "kept").distinct()
    copies = scratch.save(copies, "copies")
    known = links.slots(copies.select("doc.doc_id", "doc.tag"))
    # Rows that are no copies but in the map: few, unless there are very many copies, and then only more work is done.
    maybe = scratch.save(links.found_in(keys.select("doc.doc_id", "doc.tag"), known), "maybe")
    others = maybe.join(copies.select("doc.*").hint("merge"), ["doc_id", "tag"], "left_anti")
    return copies, known, links.slots(others)


def _stretched(runs: DataFrame, words: DataFrame) -> DataFrame:
    """Runs with start and end moved out as far as the words agree with the kept text's."""
    runs = runs.groupBy("doc", "kept").agg(F.collect_list(F.struct("a", "b", "p", "q")).alias("runs"))  # at most a document's paragraphs
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("doc"), F.lit(links.SALTS)).cast("int"))
    theirs = salted.select("kept", "salt").distinct().join(words.select(F.col("doc").alias("kept"), F.col("hashes").alias("theirs")), "kept")
    rows = salted.join(words.select("doc", F.col("hashes").alias("own")), "doc").join(theirs, ["kept", "salt"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for k, (each, x, y) in enumerate(zip(*(c.to_pylist() for c in batch.columns[2:]))):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                for r in each:
                    back = _agree(x[: r["a"]][::-1], y[: r["p"]][::-1])
                    on = _agree(x[r["b"] :], y[r["q"] :])
                    out.append((k, r["a"] - back, r["b"] + on, r["p"] - back))
            c = list(zip(*out)) or [[]] * 4
            at, *rest = (pa.array(v, t) for v, t in zip(c, [pa.int64(), pa.int32(), pa.int32(), pa.int32()]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *rest], names=["doc", "kept", "start", "end", "kept_start"])

    return rows.select("doc", "kept", "runs", "own", "theirs").mapInArrow(run, f"doc {_DOC}, kept {_DOC}, start int, end int, kept_start int")


def _promising(runs: DataFrame, least: int) -> DataFrame:
    """The runs that, stretched and joined, may come to `least` words: up to the ends of the paragraphs around them, as further ones do not match."""
    w = Window.partitionBy("doc").orderBy("lo", F.desc("hi"), "other", "run")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("lo") <= F.col("before"), 0).otherwise(1)).over(w)
    rows = runs.withColumn("before", before).withColumn("island", island)
    whole = Window.partitionBy("doc", "island")
    return rows.withColumn("reach", F.max("hi").over(whole) - F.min("lo").over(whole)).where(F.col("reach") >= least)


def _passages(stretched: DataFrame) -> DataFrame:
    """Runs that overlap or touch as one, with the document that holds the longest of them. A window holds the runs of one document."""
    w = Window.partitionBy("doc").orderBy("start", F.desc("end"), "kept")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    nth = F.sum(F.when(F.col("start") <= F.col("before"), 0).otherwise(1)).over(w)
    rows = stretched.withColumn("before", before).withColumn("nth", nth)
    best = F.max_by(F.struct("kept", F.col("kept_start")), F.struct(F.col("end") - F.col("start"), -F.col("kept.doc_id"))).alias("k")
    return rows.groupBy("doc", "nth").agg(F.min("start").alias("start"), F.max("end").alias("end"), best).select("doc", "start", "end", "k.kept", "k.kept_start")


def passages(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """(doc, start, end, kept, kept_start) of the passages that go, documents as struct<doc_id, tag>."""
    docs = docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())
    copies, known, others = whole_copies(docs, scratch)
    parts = scratch.save(paragraphs(docs, known, others), "paragraphs")
    at = F.struct("doc", "no", "word", "words")
    classes = parts.groupBy("h").agg(F.min(at).alias("first"), F.max("doc.doc_id").alias("last"), F.count("*").alias("n"), *[F.min(f"m{b}").alias(f"m{b}") for b in range(BANDS)])
    classes = scratch.save(classes, "classes")
    met = scratch.save(_met(classes), "met")
    pairs = scratch.save(_candidates(met), "pairs")
    tried = links.slots(pairs.select(F.explode(F.array("a", "b")).alias("id")))
    homes = links.slots(classes.select("h", "first.doc.doc_id", "first.doc.tag", "first.no"), tried, by=1, rows=pairs.count())
    sets = scratch.save(paragraph_sets(docs, homes).groupBy("id").agg(F.min("items").alias("items")), "sets")
    near = links.verified(pairs, sets, scratch)
    group = links.components(near, scratch)
    more = scratch.save(_more_links(met, sets, group), "more")
    scratch.drop(met, pairs, sets)
    group = links.joined_up(group, more, scratch)
    # Of all classes only those with a link, or in several documents, go on; then of all paragraphs only those of such classes.
    some = links.found_in(classes.select("h", "first", "n"), links.slots(group.select("id")), "h")
    linked = some.join(group, some["h"] == group["id"])
    head = linked.groupBy("component").agg(F.min("first").alias("first"))
    kept = linked.select("h", "n", "component").join(head, "component").select("h", "n", "first")
    alone = classes.where("first.doc.doc_id < last").join(group, classes["h"] == group["id"], "left_anti").select("h", "n", "first")
    kept = scratch.save(kept.unionByName(alone), "kept")
    scratch.drop(classes)
    found = links.hot_join(links.found_in(parts.select("doc", "no", "word", "words", "lo", "hi", "h"), links.slots(kept.select("h")), "h"), kept, ["h"]).where(F.col("first.doc.doc_id") != F.col("doc.doc_id"))
    # Islands of paragraphs of one document against one other: each window holds the paragraphs of one document.
    w = Window.partitionBy("doc", "other").orderBy("no")
    rows = found.select("doc", F.col("first.doc").alias("other"), "no", "word", "words", "lo", "hi", F.col("first.word").alias("p"), F.col("first.words").alias("pw"))
    new = F.when((F.col("no") - F.lag("no").over(w) <= GAP) & (F.abs((F.col("word") - F.lag("word").over(w)) - (F.col("p") - F.lag("p").over(w))) <= SHINGLE), 0).otherwise(1)
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy("doc", "other", "run").agg(
        F.min("word").alias("a"), F.max(F.col("word") + F.col("words")).alias("b"), F.min_by("p", "no").alias("p"), F.max_by(F.col("p") + F.col("pw"), "no").alias("q"), F.min("lo").alias("lo"), F.max("hi").alias("hi")
    )
    runs = scratch.save(_promising(runs, least).select("doc", F.col("other").alias("kept"), "a", "b", "p", "q"), "runs")
    need = links.slots(runs.select(F.explode(F.array("doc", "kept")).alias("doc")).select("doc.*").distinct())
    words = scratch.save(word_rows(docs, need).groupBy("doc").agg(F.min("hashes").alias("hashes")), "words")
    # A copy that the first pass looked at after all is told by `copies` alone.
    parted = _passages(_stretched(runs, words)).where(F.col("end") - F.col("start") >= least).join(copies.select("doc").hint("merge"), "doc", "left_anti")
    whole = copies.where(F.col("n_words") >= least).select("doc", F.lit(0).alias("start"), F.col("n_words").alias("end"), "kept", F.lit(0).alias("kept_start"))
    return parted.unionByName(whole)


def repeats(docs: DataFrame, scratch: Scratch, least: int = LEAST) -> DataFrame:
    """One row per passage that goes: doc_id, start_word, end_word, kept_doc_id, kept_start_word (words from 0, end exclusive).

    A passage goes if it has `least` words or more and they stand in documents of lesser
    doc_ids; of several, kept_doc_id holds the longest part of it, which begins there at
    kept_start_word. Null and empty texts have none. A null doc_id takes no part. Equal rows
    are one document; rows that repeat a doc_id with differing texts are looked at each by
    itself, and not held against each other. An empty table gives no rows; other columns
    are ignored.
    """
    found = passages(docs, scratch, least)
    return found.select("doc.doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept_start").alias("kept_start_word"))


def remove(docs: DataFrame, spans: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without the words of the spans (doc, start, end); n_chars follows where it exists.

    Every document stays, also one without words left. Words go only from rows of the text
    that the span was found in. Only rows that may have words to lose are shuffled.
    """
    lists = scratch.save(spans.groupBy("doc.doc_id").agg(F.collect_set(F.struct("doc.tag", "start", "end")).alias("spans")), "spans")  # at most a document's passages
    names = docs.columns
    at, extra = names.index("text"), links.fresh(names, "spans")
    touched, rest = links.parted(docs, lists)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns[: len(names)])
            texts, sizes = cols[at].to_pylist(), [None] * batch.num_rows
            for k, found in enumerate(batch.column(len(names)).to_pylist()):
                if found and texts[k]:
                    tag = text_tag(texts[k].encode())
                    own = sorted((s["start"], s["end"]) for s in found if s["tag"] == tag)
                    if own:
                        texts[k] = without(texts[k], own)
                        sizes[k] = len(texts[k])
            yield pa.RecordBatch.from_arrays(links.edited(cols, names, texts, sizes), names=names)

    return touched.join(lists.withColumnRenamed("spans", extra).hint("merge"), "doc_id", "left").select(*names, extra).mapInArrow(run, docs.schema).union(rest)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without its words in the spans, and without the white space after each of them."""
    raw = np.frombuffer(text.encode(), np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    begins = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
    bounds = np.concatenate([begins, [len(raw)]])
    keep = np.ones(len(raw), bool)
    for start, end in spans:
        keep[bounds[start] : bounds[min(end, len(begins))]] = False
    return raw[keep].tobytes().decode()


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without the passages that stand in an earlier one."""
    return remove(docs, scratch.save(passages(docs, scratch), "repeats"), scratch)
