"""Best-fit packing of token pieces into fixed-length sequences.

Bounded-space online best-fit: every task holds a fixed number of open sequences in
a bitset keyed by free space. A piece goes to the fullest open sequence that still
holds it (the lowest set bit at or above its length); with none, a new sequence
opens, and beyond the fixed number the fullest closes first.

Texts are packed in one narrow pass: no shuffle of them, memory bounded by the open bins, one Arrow batch and the
ids of recent words (recent.py), which a task gives back at its end.
Each task packs its own input split, so a lost task repeats only itself and numbers
its sequences as before (partition id in the high bits). The sequences that splits leave
well under full are packed once more as wholes, by the same rule: only numbers move then.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.recent import Recent, give_back, small_batches
from folio.llm.scratch import Scratch
from folio.llm.text import binary_column, slices

SEQUENCE = 4096
OPEN_BINS = 1024
END_ID = 1
#: Words of one of two generations that a task remembers: some 80 MB at most.
WORDS = 200_000
#: Sequences filled to less than this share are packed again, so many in a task.
UNDER, TOGETHER = 0.95, 200_000
_PUNCTUATION = b".,;:!?()[]{}\"#$%&*+-/=@^_`~|"


class OpenBins:
    """A fixed number of open sequences, in a bitset keyed by free space."""

    def __init__(self, size: int = SEQUENCE, most: int = OPEN_BINS):
        self.size, self.most = size, most
        self.bits, self.count, self.opened = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(size + 1)]

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        found = bins.pop()
        if not bins:
            self.bits &= ~(1 << free)
        self.count -= 1
        return found

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece of 1 to `size` tokens."""
        above = self.bits >> length
        if above:
            free = length + (above & -above).bit_length() - 1
            seq = self._take(free)
        else:
            free, seq = self.size, self.opened
            self.opened += 1
        left = free - length
        if left:
            if self.count == self.most:
                self._take((self.bits & -self.bits).bit_length() - 1)
            self.by_free[left].append(seq)
            self.bits |= 1 << left
            self.count += 1
        return seq, self.size - free


class WordIds(Recent):
    """White-space separated piece of a text to its ids as little-endian 32-bit bytes.

    The tokenizer drops white space and no pre-token spans it, so the ids of a text are
    those of its pieces in order. Only new pieces reach the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(WORDS)
        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.final = np.zeros(max(vocab.values()) + 64, bool)
        self.final[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def learn(self, pieces: list[bytes]) -> None:
        new = self.missing(set(pieces))
        if not new:
            return
        split, bare = {}, set()
        for p in new:
            stem = p.rstrip(_PUNCTUATION)
            if len(stem) < len(p) and stem and stem.decode().isalpha():
                split[p] = (stem, p[len(stem) :])
                bare.update(split[p])
            else:
                bare.add(p)
        bare = [p for p in bare if p not in self]
        words = [w for w in bare if w.decode().isalpha()]
        for i in range(0, len(words), 500):
            self._together(words[i : i + 500])
        rest = [p for p in bare if p not in self]
        for p, e in zip(rest, self.tok.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)):
            self[p] = np.asarray(e.ids, "<u4").tobytes()
        for p, (a, b) in split.items():
            self[p] = self[a] + self[b]

    def _together(self, words: list[bytes]) -> None:
        """Words of letters alone end in a word-final token each: one call encodes many."""
        ids = np.asarray(self.tok.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.final[ids]) + 1
        if len(ends) == len(words) and (not len(ids) or ends[-1] == len(ids)):
            raw, a = ids.tobytes(), 0
            for w, b in zip(words, ends.tolist()):
                self[w] = raw[a * 4 : b * 4]
                a = b

    def encode(self, text: bytes) -> bytes:
        pieces = (text if b"<|" in text else text.lower()).split()
        self.learn(pieces)
        return b"".join(map(self.__getitem__, pieces))


_ids: dict[str, WordIds] = {}


def pack(docs: DataFrame, tokenizer: str, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: its place in a sequence of `sequence` tokens.

    A document is its ids and the end id; only longer ones are cut, every cut piece but
    the last being full. `with_ids` adds the piece's ids as array<int>. A null text is
    empty and makes a piece of the end id alone; a null doc_id stays null; repeated rows
    are packed each on their own; an empty table gives no rows; other columns are ignored.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", ids array<int>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ids:
            _ids[tokenizer] = WordIds(tokenizer)
        enc, bins, base = _ids[tokenizer], OpenBins(sequence, open_bins), TaskContext.get().partitionId() << 33
        end, width = np.asarray([END_ID], "<u4").tobytes(), 4 * sequence
        for batch in slices(batches, 1000):
            out: list[list] = [[] for _ in range(7 + with_ids)]
            for doc, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text")):
                raw = enc.encode(text) + end
                for k, a in enumerate(range(0, len(raw), width)):
                    part = raw[a : a + width]
                    seq, at = bins.place(len(part) // 4)
                    for col, v in zip(out, (doc, k, a // 4, len(part) // 4, zlib.crc32(part), base + seq, at)):
                        col.append(v)
                    if with_ids:
                        out[7].append(np.frombuffer(part, "<u4").astype(np.int32))
            types = [pa.int64(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=[x.split()[0] for x in schema.split(", ")])
        enc.forget()
        give_back()

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def repacked(rows: DataFrame, scratch: Scratch, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """The saved rows of `pack`, in which sequences well under full share a sequence where they fit, the longest first."""
    loose = scratch.save(rows.groupBy("sequence_id").agg(F.sum("length").alias("used")).where(F.col("used") < UNDER * sequence), "loose")
    tasks = 1 + loose.count() // TOGETHER
    dealt = loose.repartition(tasks, "sequence_id").sortWithinPartitions(F.desc("used"), "sequence_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, base = OpenBins(sequence, open_bins), 1 << 62 | TaskContext.get().partitionId() << 33
        for batch in batches:
            places = [bins.place(n) for n in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([base + s for s, _ in places], pa.int64()), pa.array([at for _, at in places], pa.int64())], names=["sequence_id", "into", "shift"])

    moved = dealt.mapInArrow(run, "sequence_id long, into long, shift long")
    out = rows.join(moved, "sequence_id", "left")
    new = {"sequence_id": F.coalesce("into", "sequence_id"), "offset": F.col("offset") + F.coalesce("shift", F.lit(0))}
    return out.select(*[new[c].alias(c) if c in new else c for c in rows.columns])


def pack_all(docs: DataFrame, tokenizer: str, scratch: Scratch, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS) -> DataFrame:
    """`pack`, and what it leaves loose packed again."""
    return repacked(scratch.save(pack(docs, tokenizer, sequence, open_bins), "packed"), scratch, sequence, open_bins)
