"""Line dedup: an exact set-similarity join of all lines; later matches are removed.

A line's tokens are its distinct words, A-Z lowered; lines match at a Jaccard similarity
of 0.75 or more. A line goes if any earlier line, by (doc_id, line), matches it.

1. One pass counts in how many lines each token occurs, in a table of fixed size keyed
   by hash, and gives each line a 128-bit key of its token set. Lines of equal sets are
   reduced to their first by partial aggregation, so a line that a third of all rows hold
   costs each task one row.
2. The first line of each set puts its tokens in order of rarity (the count of the
   token's slot, then the token: one order for all lines, which is all that the prefix
   filter needs) and deals its first n // 4 + 1 tokens by hash, packed as bytes.
3. Lines that share a dealt token are candidates if their lengths, the token's positions
   and parity maps of their tokens, 128 bits or 256 for long lines, leave room for the
   overlap. Entries of a token lie in order of length, so that a line meets only those of
   fitting lengths, and the shorter of two only with its first n // 7 + 1 tokens. Of all
   candidate pairs only a spanning forest leaves the task: its components are clusters
   that no link crosses.
4. The full sets of a cluster meet in one place, or, in blocks, each pair of blocks does.
   There all pairs that pass the filters are verified. What leaves is, for each line, the
   number of its links, the earliest line among them, and a forest of the links, whose
   components are the classes. So no pairs are written, and no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm import links
from folio.llm.scratch import Scratch
from folio.llm.text import binary_column, mix, pieces, slices, word_hashes

_U = np.uint64
SLOT_BITS, HASH_BITS = 16, 50
LOW_BITS = HASH_BITS - SLOT_BITS
_MOST_LINES = 1 << (64 - HASH_BITS)
_FLUSH = 1 << 17
_ENTRY = np.dtype([("doc", "<i8"), ("no", "<i8"), ("bits", "<u8", 2), ("upper", "<u8", 2), ("token", "<u4"), ("n", "<u4"), ("at", "<u4")])
#: Lines with entries in one part, about: parts grow in number with the lines, not in size.
PART_LINES = 1 << 17
#: Rows of clusters that are compared at once; a pair of blocks is never divided.
CHUNK = 1 << 12
#: Pairs of entries that are tried at once.
AT_ONCE = 1 << 17
#: Lines of a block of a cluster.
BLOCK = 512
#: Lines of more tokens have parity maps of 256 bits, whose halves together are the map of 128.
LONG = 128
_LINE = "struct<doc_id: long, no: long>"


def _reorder(h: np.ndarray, ranks: np.ndarray | None) -> np.ndarray:
    """Tokens of HASH_BITS bits whose natural order is that of rarity: the slot gives way to its rank."""
    if ranks is None:
        return h
    return ranks[(h >> _U(LOW_BITS)).astype(np.int64)] << _U(LOW_BITS) | h & _U((1 << LOW_BITS) - 1)


def token_sets(wh: np.ndarray, owner: np.ndarray, n: int, ranks: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, sizes): the distinct tokens of n lines, at most _MOST_LINES, in order, end to end; owner: each word's line."""
    key = owner.astype(np.uint64) << _U(HASH_BITS) | _reorder(wh >> _U(64 - HASH_BITS), ranks)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key & _U((1 << HASH_BITS) - 1), np.bincount((key >> _U(HASH_BITS)).astype(np.int64), minlength=n)


def _sums(values: np.ndarray, sizes: np.ndarray, op: np.ufunc) -> np.ndarray:
    out = np.zeros(len(sizes), np.uint64)
    full = sizes > 0
    if full.any():
        out[full] = op.reduceat(values, (np.cumsum(sizes) - sizes)[full])
    return out


def set_hashes(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 128-bit key of each set, as two longs; tokens as without ranks."""
    size = sizes.astype(np.uint64)
    return tuple(mix(_sums(mix(tokens + c), sizes, np.add) + size).view(np.int64) for c in (_U(0), _U(0xC2B2AE3D27D4EB4F)))


def text_tag(raw: bytes) -> int:
    """31 bits of a text, which tell the lines of rows apart that repeat a doc_id with differing texts."""
    return xxhash.xxh64_intdigest(raw) >> 33


def _lines(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(text, no, words, owner) of runs of lines: each line's text and number (its text's tag, then its place), all words' hashes and their lines."""
    base = 0
    for piece in pieces(texts):
        raw = b"\n".join(piece)
        wh, starts, _ = word_hashes(raw)
        breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
        bounds = np.cumsum([len(t) + 1 for t in piece])[:-1] - 1  # the joints are line breaks too
        text = np.searchsorted(bounds, np.concatenate([[-1], breaks]), "right")
        tags = np.array([text_tag(t) for t in piece], np.int64)
        no = np.arange(len(text)) - np.searchsorted(text, text) | tags[text] << 32
        owner = np.searchsorted(breaks, starts)
        for a in range(0, len(text), _MOST_LINES):
            lo, hi = np.searchsorted(owner, [a, a + _MOST_LINES])
            yield base + text[a : a + _MOST_LINES], no[a : a + _MOST_LINES], wh[lo:hi], owner[lo:hi] - a
        base += len(piece)


def survey(docs: DataFrame) -> DataFrame:
    """A row (doc_id, no, s1, s2) for each line with words; and for each task rows (slot, n), the lines that hold a token of the slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "no", "s1", "s2", "slot", "n"]
        counts = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in slices(batches):
            for text, no, wh, owner in _lines(binary_column(batch, "text")):
                tokens, sizes = token_sets(wh, owner, len(text))
                counts += np.bincount((tokens >> _U(LOW_BITS)).astype(np.int64), minlength=1 << SLOT_BITS)
                full = np.flatnonzero(sizes)
                none = [pa.nulls(len(full), pa.int32()), pa.nulls(len(full), pa.int64())]
                keys = [pa.array(h[full]) for h in set_hashes(tokens, sizes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text[full])), pa.array(no[full]), *keys, *none], names=names)
        some = np.flatnonzero(counts)
        none = [pa.nulls(len(some), pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(counts[some])], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, no long, s1 long, s2 long, slot int, n long")


def slot_ranks(surveyed: DataFrame) -> np.ndarray:
    """Rank of each slot by its count, rarest first. The driver gets one row for each of a fixed number of slots."""
    rows = surveyed.where("slot is not null").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    for r in rows:
        counts[r["slot"]] = r["n"]
    ranks = np.empty(1 << SLOT_BITS, np.uint64)
    ranks[np.argsort(counts, kind="stable")] = np.arange(1 << SLOT_BITS, dtype=np.uint64)
    return ranks


def _dealt(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, line, position) of the prefix tokens of lines."""
    own = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pick = at <= sizes[own] // 4
    return mix(tokens[pick]), own[pick], at[pick]


def _maps(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity maps of lines: the halves together, and the upper half of long ones. Their bits are those that ranks leave as they are."""
    bit = _U(1) << tokens % _U(64)
    word = tokens >> _U(6) & _U(3)
    quarter = [_sums(np.where(word == k, bit, _U(0)), sizes, np.bitwise_xor) for k in range(4)]
    upper = np.where((sizes > LONG)[:, None], np.stack(quarter[2:], 1), _U(0))
    return np.stack([quarter[0] ^ quarter[2], quarter[1] ^ quarter[3]], 1), upper


def packed(e: np.ndarray) -> bytes:
    """Entries byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(e.view(np.uint8).reshape(-1, _ENTRY.itemsize).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(planes.reshape(_ENTRY.itemsize, -1).T).reshape(-1).view(_ENTRY)


def _entries(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entries without token, doc and no; token hashes; line of each) of the prefixes of lines."""
    spread, own, at = _dealt(tokens, sizes)
    bits, upper = _maps(tokens, sizes)
    e = np.empty(len(own), _ENTRY)
    e["bits"], e["upper"], e["n"], e["at"] = bits[own], upper[own], sizes[own], at
    return e, spread, own


def prefixes(docs: DataFrame, ranks: np.ndarray, parts: int, again: links.Slots, firsts: links.Slots) -> DataFrame:
    """(part, entries): prefix tokens of each line but those that are known to repeat a set, packed by part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, dealt, rows = [], [], 0

        def flush() -> pa.RecordBatch:
            e = np.concatenate(held)
            part = np.concatenate(dealt)
            order = np.argsort(part, kind="stable")
            e, part = e[order], part[order]
            which, at = np.unique(part, return_index=True)
            return pa.RecordBatch.from_arrays([pa.array(which), pa.array([packed(x) for x in np.split(e, at[1:])], pa.binary())], names=["part", "entries"])

        for batch in slices(batches):
            ids = batch.column(0).to_numpy()
            for text, no, wh, owner in _lines(binary_column(batch, "text")):
                doc = ids[text]
                stay = (~again.has(doc, no) | firsts.has(doc, no))[owner]
                e, spread, own = _entries(*token_sets(wh[stay], owner[stay], len(text), ranks))
                # Within a part, 32 bits of a token's hash tell tokens apart; two that do not only make candidates.
                dealt.append((spread % _U(parts)).astype(np.int32))
                e["token"], e["doc"], e["no"] = spread >> _U(32), doc[own], no[own]
                held.append(e)
                rows += len(e)
                if rows >= _FLUSH:
                    yield flush()
                    held, dealt, rows = [], [], 0
        if rows:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, "part int, entries binary")


def labelled(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least label of each node's component, given labels that point to lesser nodes and more links x, y."""
    while True:
        least = np.minimum(label[x], label[y])
        new = label.copy()
        for side in (x, y):
            np.minimum.at(new, side, least)
            np.minimum.at(new, label[side], least)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            return label
        label = new


def pairs_of(e: np.ndarray, node: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(left, right): candidate pairs of entries sorted by (token, n).

    node: with it, the line of each entry from 0; then pairs of lines that others join already may be left out.
    """
    n, at = e["n"].astype(np.int64), e["at"].astype(np.int64)
    lower, upper = e["bits"].T.copy(), e["upper"].T.copy()
    key = e["token"].astype(np.int64) << 31 | n
    token = key & ~np.int64((1 << 31) - 1)
    left_after = n - at
    is_short = at <= n // 7
    short = np.flatnonzero(is_short)  # Jaccard of 3/4: of two lines, the shorter shares 6/7 of its tokens at least
    lefts, rights = [short[:0]], [short[:0]]
    label = None if node is None else np.arange(node.max(initial=-1) + 1)

    def attempt(x: np.ndarray, other: np.ndarray) -> None:
        if label is not None:
            ok = label[node[x]] != label[node[other]]
            x, other = x[ok], other[ok]
        total = n[x] + n[other]
        need = -(-3 * total // 7)  # 4 * shared >= 3 * (total - shared)
        ok = np.minimum(left_after[x], left_after[other]) >= need
        x, other, room = x[ok], other[ok], (total - 2 * need)[ok]
        both_long = np.where(np.minimum(n[x], n[other]) > LONG, ~_U(0), _U(0))
        differ = np.zeros(len(x), np.int64)
        for low, up in zip(lower, upper):
            high = (up[x] ^ up[other]) & both_long
            differ += np.bitwise_count(low[x] ^ low[other] ^ high)
            differ += np.bitwise_count(high)
        ok = differ <= room
        lefts.append(other[ok])
        rights.append(x[ok])

    def walk(x: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        """Tries each of x with the short entries from start down to after stop: the nearest of all, the next of all, and so on; few that are left at once."""
        nonlocal label
        k, known = 0, 0
        while True:
            some = start - k > stop
            x, start, stop = x[some], start[some], stop[some]
            if not len(x):
                break
            left = start - k - stop
            total = int(left.sum())
            if total <= AT_ONCE:
                each = np.repeat(np.arange(len(x)), left)
                attempt(x[each], short[(start - k)[each] - (np.arange(total) - np.repeat(np.cumsum(left) - left, left))])
                break
            attempt(x, short[start - k])
            k += 1
            if label is not None and k & (k - 1) == 0:
                label = labelled(label, node[np.concatenate(lefts[known:])], node[np.concatenate(rights[known:])])
                known = len(lefts)

    # The first token that two similar lines share is among the first n // 7 + 1 of the shorter, and of both if they are equally
    # long; so each entry meets the short entries before it whose length is three quarters of its own or more.
    # Its position bounds what is left of it, and so the length that the other may have.
    longest = np.searchsorted(key[short], token | np.maximum(7 * left_after // 3 - n, 0), "right") - 1
    walk(np.arange(len(e)), np.minimum(np.cumsum(is_short) - is_short - 1, longest), np.searchsorted(key[short], token | -(-3 * n // 4)) - 1)
    return np.concatenate(lefts), np.concatenate(rights)


def forest(dealt: DataFrame, parts: int) -> DataFrame:
    """(a, id, doc_id, no): pairs that join all lines which candidate pairs join; a and id are hashes of lines, doc_id and no name the latter.

    Of the lines that are joined in a part one is paired with all, itself included.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in links.runs(slices(batches, 64), 1):
            e = np.concatenate([unpacked(x) for x in blobs])
            key = e["token"].astype(np.int64) << 31 | e["n"]
            order = np.argsort(key, kind="stable")
            token = key[order] >> 31
            same = token[1:] == token[:-1]
            e = e[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]]  # tokens that several lines hold
            ids, first, node = np.unique(links.mixed(e["doc"], e["no"]).view(np.int64), return_index=True, return_inverse=True)
            left, right = pairs_of(e, node)
            label = labelled(np.arange(len(ids)), node[left], node[right])
            some = np.unique(np.concatenate([node[left], node[right]]))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (ids[label[some]], ids[some], e["doc"][first[some]], e["no"][first[some]])], names=["a", "id", "doc_id", "no"])

    return dealt.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(run, "a long, id long, doc_id long, no long")


def line_sets(docs: DataFrame, ranks: np.ndarray, wanted: links.Slots) -> DataFrame:
    """(doc_id, no, items) of the lines with words that may be wanted; only their words are hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = binary_column(batch, "text")
            parts = [t.split(b"\n") for t in texts]
            size = np.array([len(x) for x in parts])
            tags = np.array([text_tag(t) for t in texts], np.int64)
            no = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) | np.repeat(tags << 32, size)
            doc = np.repeat(batch.column(0).to_numpy(), size)
            keep = np.flatnonzero(wanted.has(doc, no))
            flat = list(chain.from_iterable(parts))
            for a in range(0, len(keep), _MOST_LINES):
                some = keep[a : a + _MOST_LINES]
                lines = [flat[k] for k in some.tolist()]
                sets, sizes = [], []
                for piece in pieces(lines):
                    wh, starts, _ = word_hashes(b"\n".join(piece))
                    owner = np.searchsorted(np.cumsum([len(x) + 1 for x in piece]), starts, "right")
                    tokens, n = token_sets(wh, owner, len(piece), ranks)
                    raw, ends = tokens.tobytes(), (8 * np.cumsum(n)).tolist()
                    sets += [raw[b - k : b] for b, k in zip(ends, (8 * n).tolist())]
                    sizes.append(n)
                full = np.flatnonzero(np.concatenate(sizes))
                yield pa.RecordBatch.from_arrays([pa.array(doc[some[full]]), pa.array(no[some[full]]), pa.array([sets[k] for k in full.tolist()], pa.binary())], names=["doc_id", "no", "items"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, no long, items binary")


def shared(tokens: np.ndarray, sizes: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens the sets x[k] and y[k] share; tokens: of all sets end to end, each in order."""
    _, name = np.unique(tokens, return_inverse=True)
    starts = np.cumsum(sizes) - sizes
    held = np.repeat(np.arange(len(sizes)), sizes) << 32 | name
    order = np.argsort(held, kind="stable")
    held = held[order]
    out = np.zeros(len(x), np.int64)
    for a in range(0, len(x), 1 << 15):
        i, j = x[a : a + (1 << 15)], y[a : a + (1 << 15)]
        i, j = np.where(sizes[i] <= sizes[j], i, j), np.where(sizes[i] <= sizes[j], j, i)
        size = sizes[i]
        pair = np.repeat(np.arange(len(i)), size)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(size) - size, size) + starts[i][pair]
        sought = j[pair] << 32 | name[at]
        hit = held[np.minimum(np.searchsorted(held, sought), len(held) - 1)] == sought
        out[a : a + (1 << 15)] = np.bincount(pair[hit], minlength=len(i))
    return out


def cluster_links(members: DataFrame) -> DataFrame:
    """doc_id, no, links, first (the earliest linked line), root (the earliest line that links lead to), of lines with links, for each pair of blocks.

    members: (bucket, n, id, doc_id, no, items): a cluster's lines, n of them; rows may be repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, i, j, own, doc, no, items in links.chunks(batches, 3, CHUNK):
            order = np.lexsort((no, doc, j, i, bucket))
            order = order[np.concatenate([[True], np.any([c[order[1:]] != c[order[:-1]] for c in (bucket, i, j, doc, no)], axis=0)])]  # repeated rows
            doc, no, own, items = doc[order], no[order], own[order], items[order]
            tokens = np.frombuffer(b"".join(items), np.uint64)
            sizes = np.array([len(x) // 8 for x in items])
            piece = np.unique(np.stack([bucket, i, j], 1)[order], axis=0, return_inverse=True)[1].ravel()
            e, spread, line = _entries(tokens, sizes)
            e["token"] = np.unique(np.stack([piece[line].astype(np.uint64), spread], 1), axis=0, return_inverse=True)[1].ravel()
            e["no"] = line
            e = e[np.argsort(e["token"].astype(np.int64) << 31 | e["n"], kind="stable")]
            left, right = pairs_of(e)
            x, y = e["no"][left], e["no"][right]
            two = i[order] != j[order]
            ok = (~two[x] | (own[x] != own[y])) & (x != y)
            both = np.unique(np.minimum(x, y)[ok] << 32 | np.maximum(x, y)[ok])
            x, y = both >> 32, both & 0xFFFFFFFF
            common = shared(tokens, sizes, x, y)
            ok = 4 * common >= 3 * (sizes[x] + sizes[y] - common)
            x, y = x[ok], y[ok]
            count = np.bincount(np.concatenate([x, y]), minlength=len(doc))
            first, root = np.full(len(doc), len(doc)), labelled(np.arange(len(doc)), x, y)
            np.minimum.at(first, x, y)
            np.minimum.at(first, y, x)
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[some]), pa.array(no[some]), pa.array(count[some]), *(pa.StructArray.from_arrays([pa.array(doc[k[some]]), pa.array(no[k[some]])], names=["doc_id", "no"]) for k in (first, root))],
                names=["doc_id", "no", "links", "first", "root"],
            )

    dealt = links.blocked(members, BLOCK).select("bucket", "i", "j", "own", "doc_id", "no", "items").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return dealt.mapInArrow(run, f"doc_id long, no long, links long, first {_LINE}, root {_LINE}")


def linked_lines(docs: DataFrame, ranks: np.ndarray, again: DataFrame, groups: DataFrame, lines: int, scratch: Scratch) -> DataFrame:
    """(id, n_links, near, class) of the lines, each the first of its set, that match lines of other sets; near: the earliest of those."""
    repeats = links.slots(again.select("doc_id", "no"))
    firsts = links.slots(groups.select("first.doc_id", "first.no"), repeats, rows=lines // links.SPARE)
    parts = max(2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines // PART_LINES)
    met = scratch.save(forest(prefixes(docs, ranks, parts, repeats, firsts), parts), "met")
    ids = scratch.save(met.select("id", "doc_id", "no").distinct().join(again.select("doc_id", "no"), ["doc_id", "no"], "left_anti"), "ids")
    group = links.components(met.select("a", F.col("id").alias("b")).where("a <> b"), scratch)
    named = ids.join(group, "id", "left").withColumn("bucket", F.coalesce("component", "id"))
    many = named.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    sets = line_sets(docs, ranks, links.slots(ids.select("doc_id", "no")))
    members = named.join(many, "bucket").join(sets, ["doc_id", "no"]).select("bucket", "n", "id", "doc_id", "no", "items")
    found = scratch.save(cluster_links(members), "links")
    a = F.struct("doc_id", "no")
    classes = links.components(found.select(a.alias("a"), F.col("root").alias("b")).where("a <> b").distinct(), scratch)
    each = found.groupBy(a.alias("id")).agg(F.sum("links").alias("n_links"), F.min("first").alias("near"))
    return scratch.save(each.join(classes, "id").withColumnRenamed("component", "class"), "linked")


def _known(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text").where(F.col("doc_id").isNotNull())


def line_classes(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, no, class, n_links, match) of all lines that match another; class, match: lines as struct<doc_id, no>."""
    docs = _known(docs)
    surveyed = scratch.save(survey(docs), "survey")
    ranks = slot_ranks(surveyed)
    lines = surveyed.where("slot is null").select("doc_id", "no", "s1", "s2")
    id_ = F.struct("doc_id", "no")
    groups = scratch.save(lines.groupBy("s1", "s2").agg(F.min(id_).alias("first"), F.count("*").alias("n")), "groups")
    many = scratch.save(groups.where("n > 1"), "many")
    again = scratch.save(links.hot_join(lines, many, ["s1", "s2"]).where(id_ != F.col("first")).select("doc_id", "no", "first").distinct(), "again")
    linked = linked_lines(docs, ranks, again, groups, groups.count(), scratch)
    scratch.drop(surveyed, groups, many)
    copied = again.groupBy(F.col("first").alias("id")).agg(F.count("*").alias("n"))
    own = F.col("id")
    known = copied.join(linked, "id", "full_outer").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("class", "id").alias("class"), "near")
    known = scratch.save(known, "known")
    ones = known.select("id.doc_id", "id.no", "class", "n_links", F.when(F.col("near") < own, F.col("near")).alias("match"))
    copies = links.hot_join(again.select("doc_id", "no", F.col("first").alias("id")), known.where("n > 0"), ["id"])
    return ones.unionByName(copies.select("doc_id", "no", "class", "n_links", F.least("id", "near").alias("match")))


def _place(line: str) -> F.Column:
    return F.col(f"{line}no").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def similar_lines(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per line that matches another: doc_id, line (from 0), class_doc_id, class_line, n_links, match_doc_id, match_line.

    A class is all lines that matches lead to, named by its earliest line. n_links counts
    the different token sets that match the line's; lines of an equal set are members of
    its class without being counted. The match is the earliest of all earlier lines that
    match; it is null for a line that has none, which stays. Lines without words match
    nothing. A null text has one empty line. Lines of a null doc_id take no part. Equal rows
    are one document; rows that repeat a doc_id with differing texts are documents of their
    own, the order among them being that of a hash of the text. An empty table gives no
    rows; other columns are ignored.
    """
    return line_classes(docs, scratch).select(
        "doc_id", _place("").alias("line"), F.col("class.doc_id").alias("class_doc_id"), _place("class.").alias("class_line"), "n_links", F.col("match.doc_id").alias("match_doc_id"), _place("match.").alias("match_line")
    )


def matches(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of similar_lines of the lines that go: doc_id, line, match_doc_id, match_line."""
    return similar_lines(docs, scratch).where("match_doc_id is not null").select("doc_id", "line", "match_doc_id", "match_line")


def dedup(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """The documents without the lines that go; n_chars follows where it exists. Every document stays, also one that has no line left.

    Lines go only from rows of the text that they were found in. Only rows that may have
    lines to lose are shuffled. Nulls, repeated rows and empty tables: as in similar_lines.
    """
    gone = scratch.save(line_classes(docs, scratch).where("match is not null").groupBy("doc_id").agg(F.collect_set("no").alias("nos")), "gone")  # at most a document's lines
    names = docs.columns
    at, extra = names.index("text"), links.fresh(names, "nos")
    touched, rest = links.parted(docs, gone)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            cols = list(batch.columns[: len(names)])
            texts, lists = cols[at].to_pylist(), batch.column(len(names)).to_pylist()
            out, sizes = [], []
            for text, nos in zip(texts, lists):
                if text is not None and nos:
                    tag = text_tag(text.encode())
                    drop = {n & 0xFFFFFFFF for n in nos if n >> 32 == tag}
                    text = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in drop) if drop else text
                    sizes.append(len(text) if drop else None)
                else:
                    sizes.append(None)
                out.append(text)
            yield pa.RecordBatch.from_arrays(links.edited(cols, names, out, sizes), names=names)

    return touched.join(gone.withColumnRenamed("nos", extra).hint("merge"), "doc_id", "left").select(*names, extra).mapInArrow(run, docs.schema).union(rest)
