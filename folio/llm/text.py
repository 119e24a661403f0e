"""Words and shingles of whole texts as NumPy hashes, for use inside Arrow workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

from folio.llm.recent import give_back

#: A-Z only; every other byte, also of a multi-byte character, stays.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: A near-duplicate stage takes shingles of five words unless its contract says otherwise.
SHINGLE = 5

_U = np.uint64
_MULT = _U(0x9E3779B97F4A7C15)
_POWERS = [_U(pow(0x9E3779B97F4A7C15, i, 1 << 64)) for i in range(SHINGLE + 1)]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective, so it adds no collisions."""
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


_TABLE = np.frombuffer(LOWER, np.uint8)
_SPACE = np.isin(np.arange(256), (9, 10, 11, 12, 13, 32))
_BASE = 0xB492B66FBE98F273
_UNBASE = pow(_BASE, -1, 1 << 64)
#: Bytes that are hashed at once; a longer text makes a piece of its own.
PIECE = 1 << 18


def _geometric(r: int, n: int) -> np.ndarray:
    out = np.full(n, r, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Tables of one piece: of fixed size, whatever the length of a text.
_up, _down = _geometric(_BASE, PIECE + 1), _geometric(_UNBASE, PIECE + 1)


def _word_sums(raw: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(polynomials, starts, ends) of the words of at most PIECE bytes."""
    n = len(raw)
    b = _TABLE[np.frombuffer(raw, np.uint8)]
    space = np.ones(n + 2, bool)
    space[1:-1] = _SPACE[b]
    edges = np.flatnonzero(space[1:] != space[:-1])
    starts, ends = edges[::2], edges[1::2]
    run = np.zeros(n + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + _U(1)) * _up[:n], out=run[1:])
    return (run[ends] - run[starts]) * _down[starts], starts, ends


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, starts, ends) of the words of a UTF-8 text, A-Z lowered; starts and ends in bytes.

    A word's hash is a polynomial of its bytes modulo 2^64, from running sums over the text.
    Longer texts are hashed piece by piece; a word that a cut falls into is put together again.
    """
    if len(raw) <= PIECE:
        sums, starts, ends = _word_sums(raw)
        return mix(sums), starts, ends
    view, parts, open_ = memoryview(raw), [], None  # open_: (sum, start) of a word that may go on
    for at in range(0, len(raw), PIECE):
        sums, starts, ends = _word_sums(view[at : at + PIECE])
        sums, starts, ends = sums.tolist(), starts + at, ends + at
        if open_ and not (len(starts) and starts[0] == at):
            parts.append(([open_[0]], [open_[1]], [at]))
        elif open_:
            sums[0] = (open_[0] + sums[0] * pow(_BASE, at - open_[1], 1 << 64)) % (1 << 64)
            starts[0] = open_[1]
        open_ = None
        if len(ends) and ends[-1] == at + PIECE:
            open_ = sums.pop(), int(starts[-1])
            starts, ends = starts[:-1], ends[:-1]
        parts.append((sums, starts, ends))
    if open_:
        parts.append(([open_[0]], [open_[1]], [len(raw)]))
    sums, starts, ends = (np.concatenate([np.asarray(x, t) for x in c]) for c, t in zip(zip(*parts), (np.uint64, np.int64, np.int64)))
    return mix(sums), starts, ends


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text; short texts are hashed together."""
    out: list[np.ndarray] = []
    for piece in pieces(texts):
        h, starts, _ = word_hashes(b"\n".join(piece))
        bounds = np.cumsum([len(t) + 1 for t in piece])
        out += np.split(h, np.searchsorted(starts, bounds[:-1]))
    return out


def pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Runs of texts of up to PIECE bytes, or of one longer text."""
    now, size = [], 0
    for t in texts:
        if now and size + len(t) > PIECE:
            yield now
            now, size = [], 0
        now.append(t)
        size += len(t) + 1
    if now:
        yield now


def words_of(text: bytes) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a UTF-8 text, A-Z in lower case."""
    return text.translate(LOWER).split()


def shingles(wh: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hash of each run of k words in order; fewer words make one shingle, none make none."""
    n = len(wh)
    if n == 0:
        return wh
    k = min(n, k)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h += wh[i : n - k + 1 + i] * _POWERS[k - i]
    return mix(h + _U(k))


def slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that what is made of a part stays small; at the end freed memory goes back to the system."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)
    give_back()


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes]:
    """Values of a string column as UTF-8 bytes; a null is empty."""
    col = batch.column(batch.schema.get_field_index(name))
    return [v or b"" for v in col.cast(pa.binary()).to_pylist()]


def set_key(sets: np.ndarray) -> tuple[int, int]:
    """A 128-bit key of a sorted array of distinct hashes, as two signed longs."""
    d = xxhash.xxh3_128_digest(np.ascontiguousarray(sets).tobytes())
    return int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True)
