"""Duplicate operators against brute force."""

import random
import re
from itertools import combinations

import pytest

from folio.llm import line_dedup, near_dedup, substring_dedup


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", low(text))


def shingle_set(text):
    w = split(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_groups(docs, texts, scratch):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    group = {i: i for i in texts}

    def find(i):
        while group[i] != i:
            i = group[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        x = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * x >= 75 * (len(sets[a]) + len(sets[b]) - x):
            p, q = sorted((find(a), find(b)))
            group[q] = p
    rows = near_dedup.groups(docs, scratch).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), find(r["doc_id"]), find(r["doc_id"]) == r["doc_id"]), r


def test_near_dedup_keeps_columns(docs, scratch):
    out = near_dedup.dedup(docs, scratch)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert None in ids and 110 in ids and 114 not in ids and 120 not in ids


def test_large_group_of_near_copies(spark, scratch):
    base = [f"v{i}" for i in range(60)]
    rows = []
    for i in range(300):
        w = base.copy()
        w[i % 60], w[(i * 7 + 1) % 60] = f"z{i}", f"u{i // 2}"
        rows.append((i, " ".join(w)))
    rows.append((1000, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.groups(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    sets = {i: shingle_set(t) for i, t in rows}
    label = {i: i for i in sets}
    near = [(a, b) for a, b in combinations(sorted(sets), 2) if 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    for _ in range(10):
        for a, b in near:
            label[a] = label[b] = min(label[a], label[b])
    assert got == label


def test_odd_sketch_estimates():
    import numpy as np

    rng = np.random.default_rng(1)
    errors = []
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[: len(a) - 40], rng.integers(0, 2**63, 40).astype(np.uint64)]))
        m = near_dedup.odd_sketch(near_dedup.minhash([a, b]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        errors.append(near_dedup.estimate(m[0], m[1:])[0] - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def lines_of(texts):
    return [(d, k, frozenset(split(line))) for d, t in sorted(texts.items()) for k, line in enumerate((t or "").split("\n"))]


def brute_lines(texts):
    """(doc, line) of each line that goes, and the earlier lines that match it."""
    lines, want = [x for x in lines_of(texts) if x[2]], {}
    for i, (d, k, s) in enumerate(lines):
        hits = {(a, b) for a, b, t in lines[:i] if 4 * len(s & t) >= 3 * len(s | t)}
        if hits:
            want[d, k] = hits
    return want


def check_lines(rows, texts):
    """Rows of similar_lines against brute force: classes, numbers of links and earliest matches."""
    lines = [x for x in lines_of(texts) if x[2]]
    first, near = {}, {}
    for d, k, t in lines:
        first.setdefault(t, (d, k))
    sets = list(first)
    label = {t: first[t] for t in sets}
    for s, t in combinations(sets, 2):
        if 4 * len(s & t) >= 3 * len(s | t):
            near.setdefault(s, []).append(t)
            near.setdefault(t, []).append(s)
    changed = True
    while changed:
        changed = False
        for s in near:
            least = min(label[t] for t in [s, *near[s]])
            changed |= least != label[s]
            label[s] = least
    times = {}
    for _, _, t in lines:
        times[t] = times.get(t, 0) + 1
    want = {}
    for d, k, t in lines:
        if t in near or times[t] > 1:
            earlier = [x for x in [first[t], *(first[o] for o in near.get(t, []))] if x < (d, k)]
            want[d, k] = (*label[t], len(near.get(t, [])), *(min(earlier) if earlier else (None, None)))
    got = {(r["doc_id"], r["line"]): (r["class_doc_id"], r["class_line"], r["n_links"], r["match_doc_id"], r["match_line"]) for r in rows}
    assert len(got) == len(rows) and got == want
    return want


def test_similar_lines(docs, texts, scratch):
    assert len(check_lines(line_dedup.similar_lines(docs, scratch).collect(), texts)) > 40


def test_line_matches(docs, texts, scratch):
    want = brute_lines(texts)
    got = {(r["doc_id"], r["line"]): (r["match_doc_id"], r["match_line"]) for r in line_dedup.matches(docs, scratch).collect()}
    assert set(got) == set(want) and all(m == min(want[k]) for k, m in got.items())


@pytest.mark.parametrize("block", [512, 8])
def test_line_crowds(spark, scratch, block, monkeypatch):
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rng = random.Random(2)
    base = [f"c{i}" for i in range(24)]
    texts = {}
    for i in range(150):
        w = base.copy()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(24)] = f"d{rng.randrange(400)}"
        texts[i] = " ".join(w)
    check_lines(line_dedup.similar_lines(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), scratch).collect(), texts)


def test_full_slot_maps_change_nothing(docs, texts, scratch, monkeypatch):
    from folio.llm import links

    want = near_dedup.groups(docs, scratch).collect(), substring_dedup.repeats(docs, scratch).collect()
    monkeypatch.setattr(links, "SLOT_BITS", 6)
    check_lines(line_dedup.similar_lines(docs, scratch).collect(), texts)
    assert sorted(map(str, near_dedup.groups(docs, scratch).collect())) == sorted(map(str, want[0]))
    assert sorted(map(str, substring_dedup.repeats(docs, scratch).collect())) == sorted(map(str, want[1]))
    for op in (line_dedup, near_dedup, substring_dedup):
        assert op.dedup(docs, scratch).columns == docs.columns


def test_rows_that_repeat_an_id(spark, scratch):
    rng = random.Random(6)
    line, other = " ".join(words(rng, 70)), " ".join(words(rng, 80))
    rows = [(1, line + "\nfirst text", 1, 2, 3), (2, "a lone line\n" + line, 1, 2, 3), (2, "something else entirely here\nnot like it", 1, 2, 3), (2, other, 1, 2, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _gone int, _spans int, nos int")
    out = sorted(r["text"] for r in line_dedup.dedup(df, scratch).collect())
    assert out == sorted([line + "\nfirst text", "a lone line", rows[2][1], other])
    out = sorted(r["text"] for r in substring_dedup.dedup(df, scratch).collect())
    assert out == sorted([line + "\nfirst text", "a lone line\n", rows[2][1], other])
    assert near_dedup.dedup(df, scratch).columns == df.columns


def test_passages_held_in_parts(spark, scratch):
    rng = random.Random(12)
    p = words(rng, 70)
    texts = [p[:47], p[23:], p, p]
    rows = [(i, " ".join(words(rng, 60, 10**6) + t + words(rng, 60, 10**6))) for i, t in enumerate(texts)]
    got = {(r["doc_id"], r["start_word"], r["end_word"]) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got == {(2, 60, 130), (3, 60, 130)}


def test_edited_passages(spark, scratch):
    """Recall of repeated passages with edited words: between two edits 50 words agree."""
    rng, rows, n = random.Random(13), [], 200
    for i in range(n):
        p = [f"p{rng.randrange(9000)}" for _ in range(160)]
        q = p.copy()
        q[rng.randrange(75, 85)] = "edited"
        rows += [(2 * i + k, " ".join([f"t{rng.randrange(9000)}" for _ in range(60)] + x)) for k, x in enumerate((p, q))]
    got = substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    cut = {}
    for r in got:
        assert r["doc_id"] % 2 == 1 and r["kept_doc_id"] == r["doc_id"] - 1 and r["start_word"] >= 59
        cut[r["doc_id"]] = cut.get(r["doc_id"], 0) + r["end_word"] - r["start_word"]
    assert sum(v >= 150 for v in cut.values()) >= 0.95 * n


def test_line_dedup_edits_texts(docs, texts, scratch):
    gone = {(r["doc_id"], r["line"]) for r in line_dedup.matches(docs, scratch).collect()}
    out = line_dedup.dedup(docs, scratch)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.collect():
        if r["doc_id"] is not None:
            want = "\n".join(x for k, x in enumerate((texts[r["doc_id"]] or "").split("\n")) if (r["doc_id"], k) not in gone)
            assert (r["text"] or "") == want


def test_passages(docs, texts, scratch):
    rows = substring_dedup.repeats(docs, scratch).collect()
    found = {r["doc_id"]: r for r in rows}
    assert set(range(81, 90)) <= set(found) and 80 not in found
    assert found[85]["kept_doc_id"] == 80 and (found[85]["start_word"], found[85]["end_word"]) == (90, 160)
    for r in rows:
        w, k = split(texts[r["doc_id"]]), split(texts[r["kept_doc_id"]])
        n = r["end_word"] - r["start_word"]
        assert n >= 50 and r["kept_doc_id"] < r["doc_id"]
        mine, theirs = set(w[r["start_word"] : r["end_word"]]), set(k[r["kept_start_word"] : r["kept_start_word"] + n + 5])
        assert len(mine & theirs) >= 0.7 * len(mine)
    clean = set(range(20, 60)) | set(range(90, 120))
    assert not clean & set(found) - {117}


def test_passage_removal(docs, texts, scratch):
    out = {r["doc_id"]: r for r in substring_dedup.dedup(docs, scratch).collect() if r["doc_id"] is not None}
    w = split(texts[85])
    assert split(out[85]["text"]) == w[:90] + w[160:] and out[85]["n_chars"] == len(out[85]["text"])
    assert out[80]["text"] == texts[80] and out[111]["text"] is None and out[120]["text"].split() == []


def test_passage_recall(spark, scratch):
    import random

    rng = random.Random(3)
    rows, planted = [], []
    for i in range(0, 400, 2):
        p = [f"p{rng.randrange(4000)}" for _ in range(rng.randrange(51, 80))]
        for d in (i, i + 1):
            rows.append((d, " ".join([f"t{rng.randrange(4000)}" for _ in range(rng.randrange(20, 90))] + p + [f"t{rng.randrange(4000)}" for _ in range(40)])))
        planted.append((i + 1, i))
    got = {(r["doc_id"], r["kept_doc_id"]) for r in substring_dedup.repeats(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()}
    assert got <= set(planted) and len(got) >= 0.95 * len(planted)


def test_empty_tables(empty, scratch):
    assert near_dedup.groups(empty, scratch).count() == 0
    assert line_dedup.dedup(empty, scratch).count() == 0
    assert substring_dedup.dedup(empty, scratch).count() == 0


def test_crowded_buckets_lose_no_paragraph_link(spark, scratch, monkeypatch):
    import numpy as np

    from folio.llm import links

    monkeypatch.setattr(links, "BLOCK", 8)
    rng = np.random.default_rng(8)
    sets = []
    for _ in range(20):  # two near copies each, all around one frequent value
        x = rng.integers(1, 2**63, 11, dtype=np.uint64)
        sets += [np.unique(np.append(x, np.uint64(0))), np.unique(np.append(x[:10], [np.uint64(0), rng.integers(1, 2**63, dtype=np.uint64)]))]
    ids = rng.permutation(len(sets)).tolist()
    want = {(min(ids[k], ids[k + 1]), max(ids[k], ids[k + 1])) for k in range(0, len(sets), 2)}
    met = spark.createDataFrame([(5, 0, h - 1, h) for h in range(1, len(sets))], "key long, first long, before long, h long")
    rows = spark.createDataFrame([(i, bytearray(x.tobytes())) for i, x in zip(ids, sets)], "id long, items binary")
    tried = {(r["a"], r["b"]) for r in links.verified(substring_dedup._candidates(met), rows, scratch).collect()}
    assert tried < want  # the first and the next alone miss some
    group = links.components(spark.createDataFrame(sorted(tried), "a long, b long"), scratch)
    more = {(r["a"], r["b"]) for r in substring_dedup._more_links(met, rows, group).collect()}
    assert tried | more == want


def test_band_keys_have_64_bits(docs):
    rows = substring_dedup.paragraphs(docs.where("doc_id is not null")).collect()
    assert max(abs(r["m0"]) for r in rows) > 2**40
