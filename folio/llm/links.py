"""Candidate pairs, exact Jaccard checks and connected components, all distributed.

Ids are longs. The driver gets counts and slot maps, which have a fixed size. Keys that
hold a large share of the rows of a join are dealt over several parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folio.llm.scratch import Scratch
from folio.llm.text import mix, slices

#: Near duplicates share at least this share of their shingles: 100 * shared >= 75 * union.
SHARE = 75
#: Parts that the pairs of one id are dealt over.
SALTS = 32
#: Members of a bucket that are compared in one piece; larger buckets are cut into blocks, and each pair of blocks is a piece.
BLOCK = 2048


#: A key of more than one row in HOT is hot: there are fewer than HOT such keys in any table.
HOT = 2000
#: A map of keys by hash has SPARE slots for each key, but no less than 2 ** LEAST_BITS and no more than 2 ** SLOT_BITS: 8 MB as bits.
SPARE, LEAST_BITS, SLOT_BITS = 16, 20, 26
_U = np.uint64


def hot_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", rows: int | None = None) -> DataFrame:
    """left joined with right, saved, which has one row for each key and in column n how many rows of left hold it.

    Rows of a hot key are dealt over SALTS parts, each of which gets a copy of the key's
    one row; n is dropped. The keys that are hot, fewer than HOT, are broadcast. rows: the
    sum of n, or more, if it is known.
    """
    least = (right.agg(F.sum("n")).first()[0] or 0 if rows is None else rows) / HOT
    hot = right.where(F.col("n") > least).select(*on, F.lit(True).alias("_hot"))
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(*[c for c, t in left.dtypes if c not in on and t != "binary"]), F.lit(SALTS)).cast("int")).otherwise(0)
    dealt = left.join(F.broadcast(hot), on, "left").withColumn("_salt", salt).drop("_hot")
    copies = F.when(F.col("n") > least, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.withColumn("_salt", F.explode(copies)).drop("n").hint("merge"), [*on, "_salt"], how).drop("_salt")


def mixed(*keys: np.ndarray) -> np.ndarray:
    """One hash of several integer columns."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = mix(h * _U(0x9E3779B97F4A7C15) + np.asarray(k).astype(np.int64).view(np.uint64) + _U(1))
    return h


class Slots:
    """A map of keys by hash, as bits: a key that was put in is found, another is with the share of slots that are in use.

    So it may only choose what is worth a look. Its size has a bound; with more keys than
    that serves, all slots are in use and everything is looked at.
    """

    def __init__(self, words: np.ndarray):
        self.words, self.drop = words, _U(65 - (64 * len(words)).bit_length())

    def has(self, *keys: np.ndarray) -> np.ndarray:
        at = mixed(*keys) >> self.drop
        return self.words[(at >> _U(6)).astype(np.int64)] >> (at & _U(63)) & _U(1) > 0


def slots(keys: DataFrame, within: Slots | None = None, by: int = 0, rows: int | None = None) -> Slots:
    """The map of the rows of integer columns. Each task and the driver hold one map.

    within: only rows that are, or seem to be, in another map; by: its keys are so many
    leading columns, and the other columns make this map's, or all columns make both.
    rows: how many keys there are, about, if it is known; else they are counted.
    """
    count = keys.count() if rows is None else rows
    bits = min(SLOT_BITS, max(min(LEAST_BITS, SLOT_BITS), (SPARE * count).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(1 << bits - 6, np.uint64)
        for batch in batches:
            if batch.num_rows:
                cols = [c.to_numpy() for c in batch.columns]
                known, own = (cols[:by], cols[by:]) if by else (cols, cols)
                slot = mixed(*own) >> _U(64 - bits)
                slot = np.unique(slot if within is None else slot[within.has(*known)])
                word, first = np.unique(slot >> _U(6), return_index=True)
                if len(word):
                    words[word.astype(np.int64)] |= np.bitwise_or.reduceat(_U(1) << (slot & _U(63)), first)
        some = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(words[some].view(np.int64))], names=["word", "bits"])

    found = keys.mapInArrow(run, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(1 << bits - 6, np.int64)
    words[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return Slots(words.view(np.uint64))


def found_in(rows: DataFrame, known: Slots, *columns: str) -> DataFrame:
    """The rows whose integer columns (all, unless some are named) are, or seem to be, in the map."""
    at = [rows.columns.index(c) for c in columns or rows.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(known.has(*(batch.column(k).to_numpy() for k in at)))) if batch.num_rows else batch

    return rows.mapInArrow(run, rows.schema)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores after it while it is a column's."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def edited(cols: list, names: list[str], texts: list[str | None], sizes: list[int | None]) -> list:
    """The columns of a batch with new texts, and n_chars, if there is one, where a size is given."""
    cols[names.index("text")] = pa.array(texts, pa.string())
    if "n_chars" in names:
        k = names.index("n_chars")
        cols[k] = pa.array([n if s is None else s for s, n in zip(sizes, cols[k].to_pylist())], cols[k].type)
    return cols


def parted(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows of docs whose key may be in ids, rows whose key is not), so that only the former need be joined with what ids tells of them."""
    known, at = slots(ids.select(key)), docs.columns.index(key)

    def side(wanted: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                col = batch.column(at)
                found = known.has(col.fill_null(0).to_numpy()) & ~col.is_null().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(found == wanted))

        return docs.mapInArrow(run, docs.schema)

    return side(True), side(False)


def similar(a: np.ndarray, b: np.ndarray, share: int = SHARE) -> bool:
    """Whether two sorted arrays of distinct hashes have a Jaccard similarity of share / 100 or more."""
    if min(len(a), len(b)) * 100 < share * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= share * (len(a) + len(b) - both)


def verified(pairs: DataFrame, sets: DataFrame, scratch: Scratch, share: int = SHARE) -> DataFrame:
    """The saved (a, b) pairs of longs whose sets pass; sets: (id, items), items the sorted distinct hashes as bytes."""
    uses = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    used = scratch.save(sets.join(uses, "id"), "used")
    a, b = (used.select(F.col("id").alias(x), F.col("items").alias(f"items_{x}"), "n") for x in "ab")
    rows = hot_join(hot_join(pairs.select("a", "b"), a, ["a"]), b, ["b"]).select("a", "b", "items_a", "items_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ok = [similar(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64), share) for p, q in zip(x, y)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    out = scratch.save(rows.mapInArrow(run, "a long, b long"), "links")
    scratch.drop(used)
    return out


def runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[np.ndarray]]:
    """Groups of rows that agree in the first `keys` columns, of batches sorted by them; columns as NumPy arrays."""
    held: list[list] = []

    def columns(batch: pa.RecordBatch) -> list:
        return [c.to_numpy(zero_copy_only=False) for c in batch.columns]

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = columns(batch)
        change = np.zeros(batch.num_rows - 1, bool)
        for c in cols[:keys]:
            change |= c[1:] != c[:-1]
        cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            part = [c[a:b] for c in cols]
            if held and any(held[0][k][0] != part[k][0] for k in range(keys)):
                yield [np.concatenate(c) for c in zip(*held)]
                held = []
            held.append(part)
    if held:
        yield [np.concatenate(c) for c in zip(*held)]


def hits(x: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """How many values each of the sets, none empty, shares with x; all are sorted and distinct."""
    flat = np.concatenate(sets)
    found = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
    return np.add.reduceat(found.astype(np.int64), np.cumsum([0, *(len(s) for s in sets[:-1])]))


def block_links(entries: DataFrame, likely: Callable[[np.ndarray, np.ndarray], np.ndarray], share: int = SHARE) -> DataFrame:
    """The links (a, b) of one bucket between different groups, confirmed in place on full sets.

    entries: (bucket, nth, id, grp, sketch, bands, items, n): n the bucket's rows, nth its
    band. A bucket of more than BLOCK rows is cut into blocks by hash, and each pair of
    blocks is dealt on its own. Pairs are compared in NumPy, in the first band that they
    share, by sketch and then by set; only links become rows. Groups that a link joins
    are one for the rest of the piece.
    """
    rows = blocked(entries).select("bucket", "i", "j", "own", "nth", "id", "grp", "sketch", "bands", "items")
    dealt = rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, nth, ids, grp, sketch, band, items in runs(batches, 3):
            bits = np.frombuffer(b"".join(sketch), np.uint64).reshape(len(ids), -1)
            keys = np.stack(band)
            sets = [np.frombuffer(x, np.uint64) for x in items]
            sizes, grp = np.array([len(x) for x in sets]), grp.copy()
            left = np.flatnonzero(own == i[0])
            right = left if i[0] == j[0] else np.flatnonzero(own == j[0])
            found: list[tuple[int, int]] = []
            for x in left.tolist():
                y = right[right > x] if i[0] == j[0] else right
                y = y[grp[y] != grp[x]]
                y = y[likely(bits[x], bits[y])]
                y = y[(keys[y] == keys[x]).argmax(1) == nth[0]] if len(y) else y
                if not len(y):
                    continue
                both = hits(sets[x], [sets[k] for k in y])
                for k in y[100 * both >= share * (sizes[x] + sizes[y] - both)].tolist():
                    if grp[k] != grp[x]:
                        found.append((min(ids[x], ids[k]), max(ids[x], ids[k])))
                        grp[grp == grp[k]] = grp[x]
            if found:
                a, b = np.array(found, np.int64).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def blocked(entries: DataFrame, block: int | None = None) -> DataFrame:
    """entries (bucket, n, id, ...) with i, j, own: a bucket of more than `block` rows is cut into blocks by hash, and each pair of blocks is a piece."""
    block = block or BLOCK
    cut = entries.withColumn("blocks", F.ceil(F.col("n") / block).cast("int")).withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})


def chunks(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[list[np.ndarray]]:
    """Columns as NumPy arrays of about `rows` rows at once, of batches sorted by the first `keys` columns; rows that agree in those stay together."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.slice(at, rows).columns])
            size += len(held[-1][0])
            if size < rows:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            change = np.zeros(size - 1, bool)
            for c in cols[:keys]:
                change |= c[1:] != c[:-1]
            cut = int(np.flatnonzero(change)[-1]) + 1 if change.any() else 0
            if cut:
                yield [c[:cut] for c in cols]
            held, size = [[c[cut:] for c in cols]], size - cut
    if size:
        yield [np.concatenate(c) for c in zip(*held)]


def near_pairs(sets: list[np.ndarray], grp: np.ndarray, side: np.ndarray, share: int = SHARE) -> list[tuple[int, int]]:
    """Pairs of sets that link different groups; of two that are linked by others already, none. Only sets of differing sides, or of side 0, are compared.

    Of two sets that pass, each holds a common value among its first n - ceil(share * n) + 1,
    rarest first. So a value that all sets hold makes no candidates where others are left.
    """
    sizes, grp = np.array([len(x) for x in sets]), grp.copy()
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, value, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((value, held[value], owner))
    value, owner = value[order], owner[order]
    at = np.arange(len(value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    pick = (at <= sizes[owner] - -(-share * sizes[owner] // 100)) & (held[value] > 1)
    value, owner = value[pick], owner[pick]
    order = np.lexsort((owner, value))
    value, owner = value[order], owner[order]
    bounds = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
    found: list[tuple[int, int]] = []
    for a in np.flatnonzero(np.diff(bounds) > 1).tolist():
        members = owner[bounds[a] : bounds[a + 1]]
        while len(members) > 1:
            x, members = members[0], members[1:]
            y = members[(grp[members] != grp[x]) & ((side[members] != side[x]) | (side[x] == 0))]
            y = y[100 * np.minimum(sizes[y], sizes[x]) >= share * np.maximum(sizes[y], sizes[x])]
            if not len(y):
                continue
            both = hits(sets[x], [sets[k] for k in y])
            for k in y[100 * both >= share * (sizes[x] + sizes[y] - both)].tolist():
                if grp[k] != grp[x]:
                    found.append((int(x), k))
                    grp[grp == grp[k]] = grp[x]
    return found


def prefix_links(entries: DataFrame, share: int = SHARE) -> DataFrame:
    """The links (a, b) of one bucket between different groups, as block_links, but found by the rarest values of full sets.

    entries: (bucket, n, id, grp, items): n the bucket's rows. Only links become rows.
    """
    dealt = blocked(entries).select("bucket", "i", "j", "own", "id", "grp", "items").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "own", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, own, ids, grp, items in runs(batches, 3):
            side = np.where(own == i[0], 1, 2) if i[0] != j[0] else np.zeros(len(ids), np.int64)
            found = near_pairs([np.frombuffer(x, np.uint64) for x in items], grp, side, share)
            if found:
                x, y = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[x], ids[y])), pa.array(np.maximum(ids[x], ids[y]))], names=["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component): for every id in links (a, b) the smallest id that it reaches.

    Each round takes the smallest label among neighbours and then that label's own label,
    so a chain shortens by doubling; rounds end when no label changes. The links of a hub
    are dealt over parts; members of a component are told its label's label likewise.
    """
    edges = scratch.save(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = scratch.save(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("component"), F.count("*").alias("n")), "labels")
    rows = edges.count()
    while True:
        near = hot_join(edges, labels.withColumnRenamed("id", "b"), ["b"], rows=rows).groupBy("a").agg(F.min("component").alias("near"))
        new = labels.join(near, labels["id"] == near["a"]).select("id", F.col("component").alias("old"), F.least("component", "near").alias("component"), "n")
        new = scratch.save(new, "step")
        heads = new.groupBy("component").agg(F.count("*").alias("n")).join(labels.select(F.col("id").alias("component"), F.col("component").alias("up")), "component")
        heads = scratch.save(heads.where("up < component"), "heads")
        if heads.limit(1).count():
            step = new
            told = hot_join(step.select("id", "old", F.col("n").alias("links"), "component"), heads, ["component"], "left", rows)
            new = scratch.save(told.select("id", "old", F.least("component", "up").alias("component"), F.col("links").alias("n")), "labels")
            scratch.drop(step)
        changed = new.where(F.col("component") != F.col("old")).limit(1).count()
        scratch.drop(labels, heads)
        path, labels = new._folio_path, new.select("id", "component", "n")
        labels._folio_path = path
        if not changed:
            scratch.drop(edges)
            out = labels.select("id", "component")
            out._folio_path = path
            return out


def joined_up(group: DataFrame, more: DataFrame, scratch: Scratch) -> DataFrame:
    """The components (id, component) of links whose components `group` are known, with more links (a, b): only components that those touch are worked on."""
    a, b = (group.select(F.col("id").alias(x), F.col("component").alias(f"c_{x}")) for x in "ab")
    between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b")).where("a <> b")
    above = components(scratch.save(between, "between"), scratch)
    touched = more.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(group.select("id"), "id", "left_anti").select("id", F.col("id").alias("component"))
    known = group.select("id", "component").union(touched)
    up = above.select(F.col("id").alias("component"), F.col("component").alias("up"))
    return scratch.save(known.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "joined")
