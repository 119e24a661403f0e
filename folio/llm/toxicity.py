"""Toxic spans by a linear-chain conditional random field over the words of a document.

Two tags, clean and toxic. Words are the runs of letters of white-space separated pieces
(a piece without letters is one word). A word's potential is the sum of the weights of its
hashed features (the word, its first 3 to 7 letters, its last 3); the chain has a
potential for each pair of tags. Marginals come from forward and backward ratios, exact up to
the warm-up of a block; they give the offending offsets and, summed, the document's
score. Scoring is one narrow pass; fitting uses a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folio.llm.recent import Recent, give_back, small_batches
from folio.llm.text import binary_column, mix, shingles, word_hashes

#: Most labelled rows of each label that a fit reads, chosen by hash of their id.
SAMPLE = 1200
#: Most bytes of text that a fit reads.
SAMPLE_BYTES = 64 << 20
#: A document is rejected from this score on.
REJECT = 0.3
BUCKETS = 1 << 19
#: A feature that labels tokens is so many times as frequent among toxic documents as among others.
TELLING = 20
_BLOCK, _WARM = 512, 96
_LETTERS = re.compile(r"[^\W\d_]+")


def likely(p: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """By document, the sum of the marginals over a half, to the fourth power: doubtful ones count little, faint ones of very long texts nothing."""
    return np.add.reduceat(np.where(p > 0.5, p**4, 0), np.concatenate([[0], ends[:-1]])) if len(ends) else np.zeros(0)


def words_of(piece: bytes) -> list[str]:
    """The runs of letters of a white-space separated piece in lower case; an empty word for one without letters."""
    return _LETTERS.findall(piece.decode("utf-8", "ignore").lower()) or [""]


def features(w: str) -> list[int]:
    """Buckets of a word's features; 0 alone for an empty word."""
    if not w:
        return [0]
    names = ["w" + w, *(f"p{w[:n]}" for n in (3, 4, 5, 6, 7) if len(w) >= n), "s" + w[-3:]]
    return [1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in names]


def _ratios(odds: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Odds of the toxic tag given all words so far, for rows of blocks; m: exp of the tag-pair potentials, from row to column."""
    out = np.empty_like(odds)
    r = np.zeros(len(odds))
    first = True
    for t in range(odds.shape[1]):
        x = odds[:, t]
        r = x.copy() if first else x * (m[0, 1] + m[1, 1] * r) / (m[0, 0] + m[1, 0] * r)
        first = False
        out[:, t] = r
    return out


def messages(scores: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward odds of the toxic tag at each word of documents laid end to end; ends: one past each document's last word.

    Forward odds include the word's own potential, backward ones do not.

    Long documents are cut into blocks with a warm-up on either side, over which the
    chain forgets where it began, and all blocks advance together.
    """
    if not len(scores):
        return np.zeros(0), np.zeros(0)
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    blocks = -(-sizes // _BLOCK)
    doc = np.repeat(np.arange(len(ends)), blocks)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    at = starts[doc] + nth * _BLOCK
    size = np.minimum(_BLOCK, ends[doc] - at)
    lead = np.minimum(_WARM, at - starts[doc])
    tail = np.minimum(_WARM, ends[doc] - at - size)
    m, forward, backward = np.exp(pairs), np.empty(len(scores)), np.empty(len(scores))
    odds = np.exp(np.clip(scores, -30, 30))
    order = np.argsort(lead + size + tail, kind="stable")
    for i in range(0, len(order), 256):
        b = order[i : i + 256]
        width = int((lead + size + tail)[b].max())
        pos = np.arange(width)[None, :]
        inside = pos < (lead + size + tail)[b][:, None]
        idx = np.where(inside, (at - lead)[b][:, None] + pos, 0)
        x = odds[idx]
        fwd = _ratios(x, m)
        # Backward: messages into each word from its right; padding passes nothing on.
        back = np.ones_like(x)
        r, done = np.ones(len(b)), (lead + size + tail)[b]
        for t in range(width - 2, -1, -1):
            y = x[:, t + 1] * r
            r = np.where(t + 1 < done, (m[1, 0] + m[1, 1] * y) / (m[0, 0] + m[0, 1] * y), 1.0)
            back[:, t] = r
        keep = inside & (pos >= lead[b][:, None]) & (pos < (lead + size)[b][:, None])
        forward[idx[keep]], backward[idx[keep]] = fwd[keep], back[keep]
    return forward, backward


def _share(forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    o = np.minimum(forward * backward, 1e15)
    return o / (1 + o)


def marginals(scores: np.ndarray, ends: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """P(toxic) of each word."""
    return _share(*messages(scores, ends, pairs))


def pair_counts(scores: np.ndarray, ends: np.ndarray, pairs: np.ndarray, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
    """Expected numbers of tag pairs of neighbours in the chains: the sums of their pairwise marginals, from the messages."""
    within = np.ones(max(0, len(scores) - 1), bool)
    within[ends[:-1] - 1] = False
    m, left = np.exp(pairs), forward[:-1][within]
    right = (np.exp(np.clip(scores, -30, 30)) * backward)[1:][within]
    joint = np.stack([np.full(len(left), m[0, 0]), m[0, 1] * right, m[1, 0] * left, m[1, 1] * left * right])
    return (joint / joint.sum(0)).sum(1).reshape(2, 2)


@dataclass
class Tagger:
    """Weights of a fitted field and of the logistic scale from marginals to a score."""

    weights: np.ndarray
    pairs: np.ndarray
    scale: np.ndarray

    def document(self, expected: np.ndarray) -> np.ndarray:
        """Score of documents from the number of surely toxic words."""
        z = self.scale[0] + self.scale[1] * np.minimum(expected, 3)
        return 1 / (1 + np.exp(-z))


class _Scores(Recent):
    """Of recent pieces, the potentials of their words as bytes."""

    def __init__(self, weights: np.ndarray):
        super().__init__(100_000)
        self.weights = weights

    def learn(self, pieces: set[bytes]) -> None:
        new = self.missing(pieces)
        each = [[features(w) for w in words_of(p)] for p in new]
        sizes = [len(f) for fs in each for f in fs]
        flat = np.array([x for fs in each for f in fs for x in f], np.int64)
        sums = np.add.reduceat(self.weights[flat], np.cumsum([0, *sizes[:-1]])) + self.weights[0] if sizes else np.zeros(0)
        raw, at = sums.astype("<f8").tobytes(), 0
        for p, fs in zip(new, each):
            self[p] = raw[at : at + 8 * len(fs)]
            at += 8 * len(fs)


def _suspect(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """Which features all but only toxic documents have, by the numbers of documents that have them: they label tokens, as labels are given for documents.

    So many documents would all be toxic by chance once in a million features at most.
    """
    least = max(3, np.log(1e6) / -np.log(n_pos / (n_pos + n_neg)))
    out = (pos >= least) & (pos / n_pos > TELLING * neg / n_neg)
    out[0] = False
    return out


def _distinct(sample: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """The rows that share none of four minimal shingle hashes with an earlier one: copies would make their words look telling."""
    seen, out = set(), []
    for text, y in sample:
        h = shingles(word_hashes(text)[0])
        keys = {(i, int(mix(h + np.uint64(i)).min())) for i in range(4)} if len(h) else {(0, 0)}
        if not keys & seen:
            out.append((text, y))
        seen |= keys
    return out


def _indexed(texts: list[bytes]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, int]:
    """(words of each text by number, word and feature of each pair of the two, number of words)."""
    ids: dict[str, int] = {}
    flat, sizes, docs = array("i"), array("i"), []
    for text in texts:
        words = array("i")
        for w in (w for piece in text.split() for w in words_of(piece)):
            if (k := ids.get(w)) is None:
                k = ids[w] = len(ids)
                found = features(w)
                flat.extend(found)
                sizes.append(len(found))
            words.append(k)
        docs.append(np.array(words, np.int32))
    return docs, np.repeat(np.arange(len(ids), dtype=np.int32), np.array(sizes, np.int64)), np.array(flat, np.int32), len(ids)


def _parts(docs: list[np.ndarray], most: int = 1 << 17) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """(documents, their words end to end, one past each one's last word) of some words at a time; documents without words are left out."""
    now, size = [], 0
    for i, d in enumerate(docs):
        if now and size + len(d) > most:
            yield now, np.concatenate([docs[k] for k in now]), np.cumsum([len(docs[k]) for k in now])
            now, size = [], 0
        if len(d):
            now.append(i)
            size += len(d)
    if now:
        yield now, np.concatenate([docs[k] for k in now]), np.cumsum([len(docs[k]) for k in now])


def _flagged(docs: list[np.ndarray], labels: list[int], wid: np.ndarray, fid: np.ndarray, n_words: int) -> np.ndarray:
    """Which words have a feature that labels tokens."""
    starts = np.searchsorted(wid, np.arange(n_words + 1))
    held = np.zeros((2, BUCKETS))
    for d, y in zip(docs, labels):
        u = np.unique(d)
        size = starts[u + 1] - starts[u]
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts[u], size)
        held[y][np.unique(fid[at])] += 1
    suspects = _suspect(held[1], held[0], sum(labels), len(labels) - sum(labels))
    return np.bincount(wid, suspects[fid], n_words) > 0


def fit(sample: list[tuple[bytes, int]], rounds: int = 30) -> Tagger:
    """A tagger from (text, label) rows; without both labels among them it scores every text by the share of label 1."""
    sample = _distinct([(t, y) for t, y in sample if y in (0, 1)])
    n_pos = sum(y for _, y in sample)
    n_neg = len(sample) - n_pos
    weights, pairs = np.zeros(BUCKETS), np.zeros((2, 2))
    if not n_pos or not n_neg:
        weights[0] = -10
        p = (n_pos + 0.01) / (len(sample) + 0.1)
        return Tagger(weights, pairs, np.array([np.log(p / (1 - p)), 0.0]))
    docs, wid, fid, n_words = _indexed([t for t, _ in sample])
    flag = _flagged(docs, [y for _, y in sample], wid, fid, n_words)
    parts = list(_parts(docs))
    gold = [flag[words] & (np.repeat([sample[i][1] for i in full], np.diff(ends, prepend=0)) == 1) for full, words, ends in parts]
    k = np.zeros((2, 2))
    for (_, _, ends), g in zip(parts, gold):
        within = np.ones(len(g) - 1, bool)
        within[ends[:-1] - 1] = False
        np.add.at(k, (g[:-1][within].astype(int), g[1:][within].astype(int)), 1)
    weights[0] = -4.0
    rate = np.full(BUCKETS, 1e-6)
    for _ in range(rounds):
        u = np.bincount(wid, weights[fid], n_words) + weights[0]
        err, both = np.zeros(n_words), np.zeros((2, 2))
        for (_, words, ends), g in zip(parts, gold):
            passed = messages(u[words], ends, pairs)
            err += np.bincount(words, g - _share(*passed), n_words)
            both += pair_counts(u[words], ends, pairs, *passed)
        grad = np.bincount(fid, err[wid], BUCKETS)
        grad[0] += err.sum()
        grad -= 0.02 * weights
        rate += grad * grad
        weights += grad / np.sqrt(rate)
        # Tag pairs: iterative scaling towards the counts of the labelled chain.
        pairs += 0.5 * np.clip(np.log((k + 1) / (both + 1)), -1, 1)
        pairs -= pairs[0, 0]
        pairs = np.clip(pairs, -4, 4)
    u, expected = np.bincount(wid, weights[fid], n_words) + weights[0], np.zeros(len(docs))
    for full, words, ends in parts:
        expected[full] = likely(marginals(u[words], ends, pairs), ends)
    del parts, gold, u, docs, wid, fid
    give_back()
    return Tagger(weights, pairs, _logistic(np.minimum(expected, 3), np.array([y for _, y in sample], float)))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Intercept and slope by Newton steps with a small ridge; both labels weigh the same in total."""
    w = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    X, beta = np.stack([np.ones_like(x), x], 1), np.zeros(2)
    for _ in range(30):
        q = 1 / (1 + np.exp(-np.clip(X @ beta, -30, 30)))
        h = X.T @ (X * (w * q * (1 - q))[:, None]) + 0.05 * np.eye(2)
        beta = beta + np.linalg.solve(h, X.T @ (w * (y - q)) - 0.05 * beta)
    return beta


def held_out(doc_id) -> F.Column:
    """Rows that a fit never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, most_bytes: int = SAMPLE_BYTES) -> list[tuple[bytes, int]]:
    """At most `most` rows of each label outside the held-out part and half of `most_bytes` of text, the first by hash of doc_id.

    A row that would exceed the bytes is left out as a whole. A doc_id that labels names
    more than once counts as toxic if any of its rows does; of differing texts of one
    doc_id the least is read.
    """
    one = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    parts = [one.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # 2 * most rows of two numbers
    found = docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    w = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id")  # 2 * most rows
    sized = found.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).withColumn("sum", F.sum(F.when(F.col("size") <= most_bytes // 2, F.col("size")).otherwise(0)).over(w))
    rows = sized.where((F.col("size") <= most_bytes // 2) & (F.col("sum") <= most_bytes // 2)).orderBy("doc_id").select("text", "toxic").collect()
    return [((r["text"] or "").encode(), r["toxic"]) for r in rows]


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Tagger:
    return fit(training_rows(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"), most))


class _Scorer:
    """Scores texts in a worker; carries only the weights that are not zero."""

    def __init__(self, tagger: Tagger):
        some = np.flatnonzero(tagger.weights)
        self.some, self.values, self.pairs, self.scale, self.known = some.astype(np.int32), tagger.weights[some], tagger.pairs, tagger.scale, None

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, list[np.ndarray]]:
        """The scores, and each text's marginals."""
        if self.known is None:
            weights = np.zeros(BUCKETS)
            weights[self.some] = self.values
            self.known = _Scores(weights)
        pieces = [t.split() for t in texts]
        self.known.learn({p for ps in pieces for p in ps})
        rows = [np.frombuffer(b"".join(map(self.known.__getitem__, ps)), "<f8") for ps in pieces]
        sizes = np.array([len(r) for r in rows], int)
        full = np.flatnonzero(sizes)
        ends = np.cumsum(sizes[full])
        p = marginals(np.concatenate([rows[k] for k in full]) if len(full) else np.zeros(0), ends, self.pairs)
        expected = np.zeros(len(rows))
        expected[full] = likely(p, ends)
        return Tagger(self.known.weights, self.pairs, self.scale).document(expected), np.split(p, np.cumsum(sizes)[:-1])

    def forget(self) -> None:
        self.known = None
        give_back()


def score(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, score (0 to 1), predicted (score >= 0.3) and spans: code point offsets of words whose toxic marginal is over a half.

    Only the text is read. A null text is empty and gets the score of no toxic word;
    repeated rows are scored alike; a null doc_id stays null; empty tables give no rows;
    other columns are ignored.
    """
    schema = "doc_id long, score double, predicted int, spans array<struct<start: int, end: int>>"
    kinds = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    scorer = _Scorer(tagger)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = binary_column(part, "text")
                s, each = scorer(texts)
                spans = [_spans(t, q) if len(q) and q.max() > 0.5 else [] for t, q in zip(texts, each)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s), pa.array((s >= REJECT).astype(np.int32)), pa.array(spans, kinds)], names=["doc_id", "score", "predicted", "spans"])
        scorer.forget()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _spans(text: bytes, q: np.ndarray) -> list[dict[str, int]]:
    """Code point offsets of the words of a text whose marginal in q is over a half."""
    out, at, chars, k = [], 0, 0, 0
    for found in re.finditer(rb"[^\x20\x09-\x0d]+", text):
        n = len(words_of(found[0]))
        if (q[k : k + n] > 0.5).any():
            chars += len(text[at : found.start()].decode())
            at, piece = found.start(), found[0].decode()
            runs = [x.span() for x in _LETTERS.finditer(piece)] if len(piece.lower()) == len(piece) else []
            runs = runs if len(runs) == n else [(0, len(piece))] * n  # letters that lower-case to several
            out += [{"start": chars + a, "end": chars + b} for (a, b), p in zip(runs, q[k : k + n]) if p > 0.5]
        k += n
    return out


def reject(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """The documents whose score is below the threshold, with all their columns; rows are scored in place, without a join."""
    scorer = _Scorer(tagger)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                yield part.filter(pa.array(scorer(binary_column(part, "text"))[0] < REJECT))
        scorer.forget()

    return docs.mapInArrow(run, docs.schema)
