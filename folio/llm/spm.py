"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a batch are sorted, which makes neighbours share trie
prefixes, and walked depth-first: the forward state of every prefix (the last piece
of its best segmentation) is kept on the path and reused by all words below it.

The public model is a merge (BPE) model, where the best path is not the one of the
highest score sum but the one greedy merging gives. Of that path each prefix has just
one last piece, and a piece can follow another exactly if merging the two alone leaves
both as they are; so the same left-to-right pass holds with that test as its score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from folio.llm.recent import MOST, Recent, give_back, small_batches
from folio.llm.text import binary_column

SPACE = "▁"
#: Words of one of two generations and pairs of pieces that a worker remembers: some 100 MB at most, given back at a task's end.
WORDS, PAIRS = 200_000, 500_000
_LATIN, _STOPS = "[A-Za-zÀ-ÖØ-öø-ɏ]", "[.,;:!?]"
_MEETING = re.compile(f"{_LATIN}{_STOPS}|{_STOPS}{_LATIN}")
_WORD = f"{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+|\n"
#: For models none of whose pieces has a Latin letter beside a stop: no merge spans them, so stops are words of their own.
_BARE_WORD = f"{SPACE}*{_LATIN}+(?={_STOPS}|[{SPACE}\n]|\\Z)|{_STOPS}+(?={_LATIN}|[{SPACE}\n]|\\Z)|{_WORD}"


class Model:
    """Pieces of a SentencePiece model file, and what is known of recent words and pairs of pieces: bounded, see recent.py."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.unknown = sp.unk_id()
        self.id_of, self.rank, self.byte_id = {}, {}, {}
        self.bytes_of: list[bytes] = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[b := int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([b])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.id_of[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes_of[i] = piece.replace(SPACE, " ").encode()
        self.longest = max(map(len, self.id_of))
        self.word = re.compile(_WORD if any(map(_MEETING.search, self.id_of)) else _BARE_WORD)
        self.words = Recent(WORDS)
        self.pairs: dict[int, bool] = {}  # by the numbers of both pieces
        self.whole: dict[str, bool] = {}
        self.count = n

    def merge(self, word: str) -> list[str]:
        """Greedy merging, best piece first and leftmost on ties: the meaning that the forward pass has to match."""
        parts, rank, worst = list(word), self.rank, float("inf")
        ranks = [rank.get(a + b, worst) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < worst:
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get(parts[i - 1] + parts[i], worst)
            if i < len(ranks):
                ranks[i] = rank.get(parts[i] + parts[i + 1], worst)
        return parts

    def _follows(self, a: str, b: str) -> bool:
        """Whether merging the two alone leaves both as they are; remembered if both are pieces of the model."""
        ok = self.merge(a + b) == [a, b]
        if a in self.id_of and b in self.id_of:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            self.pairs[self.id_of[a] * self.count + self.id_of[b]] = ok
        return ok

    def _stands(self, a: str) -> bool:
        if (ok := self.whole.get(a)) is None:
            if len(self.whole) > MOST:
                self.whole.clear()
            ok = self.whole[a] = self.merge(a) == [a]
        return ok

    def _extend(self, word: str, last: list[tuple[int, int]]) -> None:
        """Adds to `last`, for each prefix of the word that it lacks, the length and number of its last piece; length 0 if no piece fits."""
        id_of, pairs, longest, count = self.id_of, self.pairs, self.longest, self.count
        for end in range(len(last), len(word) + 1):
            found = 0, -1
            for at in range(max(0, end - longest), end):
                piece = word[at:end]
                j = id_of.get(piece, -1)
                if j < 0 and at < end - 1:
                    continue
                if not at:
                    if self._stands(piece):
                        found = end, j
                        break
                    continue
                size, i = last[at]
                if not size:
                    continue
                ok = pairs.get(i * count + j) if i >= 0 and j >= 0 else None
                if self._follows(word[at - size : at], piece) if ok is None else ok:
                    found = end - at, j
                    break
            last.append(found)

    def _ids(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.id_of.get(p)
            if i is not None:
                out.append(i)
            elif self.byte_id:
                out += [self.byte_id[b] for b in p.encode()]
            elif not out or out[-1] != self.unknown:
                out.append(self.unknown)
        return out

    def learn(self, words: set[str]) -> None:
        """Encodes new words: depth-first over the trie that their sorted order is."""
        before, last, id_of = "", [(0, -1)], self.id_of
        for word in sorted(self.words.missing(words)):
            same = 0
            for a, b in zip(before, word):
                if a != b:
                    break
                same += 1
            del last[same + 1 :]
            self._extend(word, last)
            ids, end = [], len(word)
            while end and (size := last[end][0]):
                ids.append(last[end][1])
                end -= size
            # No path, or a character that is no piece: plain merging says what it becomes.
            ids = self._ids(self.merge(word)) if end or -1 in ids else ids[::-1]
            self.words[word] = np.asarray(ids, "<i4").tobytes()
            before = word

    def split(self, text: str) -> list[str]:
        """Marked words: no piece spans a space that follows another character, or a line feed."""
        return self.word.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the ids of all texts end to end, and where each text's begin and the last one's end."""
        rows = [self.split(t) for t in texts]
        self.learn({w for r in rows for w in r})
        blobs = [b"".join(map(self.words.__getitem__, r)) for r in rows]
        return np.frombuffer(b"".join(blobs), "<i4"), np.cumsum([0, *(len(b) // 4 for b in blobs)])

    def forget(self) -> None:
        self.words.forget()
        self.pairs.clear()
        self.whole.clear()
        give_back()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, bounds = self.flat(texts)
        return np.split(ids, bounds[1:-1])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[bytes]:
        """The texts of ids end to end, sizes[k] of them for text k."""
        got, at, out = list(map(self.bytes_of.__getitem__, ids.tolist())), 0, []
        for n in sizes.tolist():
            raw = b"".join(got[at : at + n])
            out.append(raw[1:] if raw[:1] == b" " else raw)
            at += n
        return out


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids of each whole text; a null or empty text has none.

    Repeated rows stay, a null doc_id stays null, empty tables give no rows, other columns
    are ignored. One narrow pass.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                ids, bounds = m.flat([t.decode() for t in binary_column(part, "text")])
                lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], names=["doc_id", "ids"])
        m.forget()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the text they stand for; no ids or null make an empty text. U+2581 in a source text comes back as a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                ids, sizes = part.column(1).flatten().fill_null(m.unknown), pc.list_value_length(part.column(1)).fill_null(0)
                texts = m.decode(ids.to_numpy(), sizes.to_numpy())
                try:
                    text = pa.array(texts, pa.binary()).cast(pa.string())
                except pa.ArrowInvalid:  # ids whose bytes are no UTF-8
                    text = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), text], names=["doc_id", "ids", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, text string")
