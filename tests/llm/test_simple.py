"""Operators that SQL cannot express: round trips, brute force and held-out accuracy."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

from folio.llm import fingerprint, license_scan, media, packing, queries, spm, text, toxicity, warc


def rows(df):
    return sorted(df.collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"]))


@pytest.mark.parametrize("again", [False, True])
def test_packing(docs, texts, scratch, again):
    from tokenizers import Tokenizer

    path = queries.tokenizer("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got, places = {}, {}
    packed = packing.pack(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).repartition(20), path, with_ids=True)
    for r in (packing.repacked(scratch.save(packed), scratch) if again else packed).collect():
        got.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        assert zlib.crc32(np.asarray(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
    for d, t in texts.items():
        pieces = sorted(got[d], key=lambda r: r["piece"])
        assert [x for p in pieces for x in p["ids"]] == tok.encode(t or "", add_special_tokens=False).ids + [1]
        assert all(p["length"] == 4096 for p in pieces[:-1]) and [p["start"] for p in pieces] == [4096 * i for i in range(len(pieces))]
    for seq in places.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= 4096
    if again:
        assert sum(r["length"] for rows_ in got.values() for r in rows_) > 0.9 * 4096 * (len(places) - 1)


def test_packing_of_odd_rows_and_fill(docs, empty, spark, scratch):
    path = queries.tokenizer("word_bpe_49k.json")
    assert packing.pack(empty, path).count() == 0 and packing.pack_all(empty, path, scratch).count() == 0
    got = packing.pack(docs, path).collect()
    assert sum(r["piece"] == 0 for r in got) == docs.count() and any(r["doc_id"] is None for r in got)
    got = packing.pack(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), path).collect()
    assert sum(r["length"] for r in got) >= 0.97 * 4096 * len({r["sequence_id"] for r in got})


def test_open_bins_are_bounded():
    bins, rng, used = packing.OpenBins(100, 16), random.Random(1), {}
    for _ in range(2000):
        n = rng.randrange(1, 101)
        seq, at = bins.place(n)
        assert at == used.get(seq, 0) and at + n <= 100 and bins.count <= 16
        used[seq] = at + n
    assert sum(used.values()) / (100 * len(used)) > 0.9


@pytest.mark.parametrize("text", ["", "it's Don't 12 3,4", "a <|endoftext|> b <|ENDOFTEXT|>", "é İ ΑΣ ΑΣ. x", "a\x1cb\x85c　d", "...!!! (x) 'll"])
def test_word_ids_equal_the_tokenizer(text):
    path = queries.tokenizer("word_bpe_49k.json")
    ids = packing.WordIds(path)
    assert np.frombuffer(ids.encode(text.encode()), "<u4").tolist() == ids.tok.encode(text, add_special_tokens=False).ids


def test_sentencepiece(docs, texts, spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = {r["doc_id"]: r for r in spm.decode(spm.encode(docs, path), path).collect()}
    for d, t in texts.items():
        assert got[d]["text"] == (t or "")
        assert got[d]["ids"] == sp.encode(t or ""), d


def test_sentencepiece_on_real_words(spark):
    import sentencepiece

    path = queries.tokenizer("piece_bpe_32k.model")
    sp, m = sentencepiece.SentencePieceProcessor(model_file=path), spm.Model(path)
    sample = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    sample += ["  two  spaces\n\n and\ttabs ", "▁ mark", "ünïcödé 漢字 😀 x", "aaaaaaaaaaaaaaaaaaaaaa", "1234567890", "the the\nthe"]
    for t, ids in zip(sample, m.encode(sample)):
        assert ids.tolist() == sp.encode(t)


def test_media(docs, texts):
    got = rows(media.probe(media.store(docs)))
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            continue
        raw = (texts[r["doc_id"]] or "").encode()
        padded = raw + bytes(-len(raw) % 64 if raw else 64)
        assert r["n_bytes"] == len(raw) and r["payload_bytes"] == len(padded)
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-64:])
        assert r["bad_checksums"] == 0 and r["skipped_bytes"] == 0 and r["samples"] == 1152 * len(r["frame_offsets"])


def test_media_resynchronises():
    payload = random.Random(1).randbytes(20000)
    stream = media.encode(payload)
    assert media.parse(stream).payload == payload
    good = media.parse(stream)
    assert good.declared_frames == len(good.offsets) and len(good.toc) == 100 and good.rate == 32000
    at = good.offsets[3]
    broken = stream[:at] + b"\xff\xfa\x00junk" + stream[at:]
    x = media.parse(broken)
    assert x.skipped == 7 and x.payload == payload
    flipped = bytearray(stream)
    flipped[at + 8] ^= 1
    assert media.parse(bytes(flipped)).bad_checksums == 1
    assert media.parse(b"").samples == 0 and media.parse(b"\xff" * 50).skipped == 50


def test_media_tags_and_versions():
    import struct

    def frame(version, rate_bits, index, mono=True):
        head = bytes((0xFF, 0xE0 | version << 3 | 2 | 1, index << 4 | rate_bits << 2, 0xC0 if mono else 0))
        bitrates, divisor, samples, *_ = media.VERSIONS[version]
        return head.ljust(samples // 8 * bitrates[index] * 1000 // (media.RATES[rate_bits] // divisor), b"\0")

    utf16, utf8 = b"\x01" + "T\u00eft".encode("utf-16"), b"\x03" + "\u6f22".encode()
    body = b"TIT2" + media._syncsafe(len(utf16)) + b"\0\0" + utf16 + b"TPE1" + media._syncsafe(len(utf8)) + b"\0\0" + utf8
    tag = b"ID3\x04\0\0" + media._syncsafe(len(body)) + body
    last = b"TAG" + b"Old".ljust(30, b"\0") + b"\0" * 30 + b"Album".ljust(30, b"\0") + b"\0" * 35
    for version, samples in ((3, 1152), (2, 576), (0, 576)):
        vbri = bytearray(frame(version, 0, 8))
        vbri[36:62] = b"VBRI" + bytes(10) + struct.pack(">I", 3) + struct.pack(">HHHH", 2, 1, 2, 1)
        x = media.parse(tag + bytes(vbri) + frame(version, 0, 5) * 3 + last)
        assert (x.samples, len(x.offsets), x.declared_frames, x.skipped, len(x.toc)) == (3 * samples, 3, 3, 0, 4)
        assert x.rate == 44100 // media.VERSIONS[version][1] and x.tags == {"TIT2": "T\u00eft", "TPE1": "\u6f22", "TALB": "Album"}


def test_media_stores_durations_and_offsets(docs, empty):
    assert media.probe(media.store(empty)).count() == 0
    for r in media.probe(media.store(docs)).collect():
        assert r["stored_as_read"] and r["samples"] == 1152 * len(r["frame_offsets"]) and r["rate"] == 32000


def test_word_hashes():
    samples = ["", " ", "a", "A b  a\tb\n", "é\x1cx É", "x" * 300000 + " y", "\x00 \x00\x00"]
    known = {}
    for t, h in zip(samples, text.hashed([t.encode() for t in samples])):
        w = text.words_of(t.encode())
        assert len(w) == len(h)
        for x, y in zip(w, h.tolist()):
            assert known.setdefault(x, y) == y
    assert len(set(known.values())) == len(known)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    rng = random.Random(3)
    raw = "".join(rng.choice("ab  c\té\n") for _ in range(3000)).encode() + b" " + b"z" * 700 + b" end" + b" " * 300
    whole = text.word_hashes(raw)
    monkeypatch.setattr(text, "PIECE", 64)
    for a, b in zip(whole, text.word_hashes(raw)):
        assert np.array_equal(a, b)
    assert len(text.word_hashes(b" " * 500)[0]) == 0 and len(text.word_hashes(b"y" * 128)[0]) == 1


def test_recent_values_are_bounded():
    from folio.llm.recent import Recent

    known = Recent(10)
    for i in range(0, 200, 5):
        new = known.missing({f"k{k}" for k in range(i, i + 5)} | {"hot"})
        assert ("hot" in new) == (i == 0)
        known.update(dict.fromkeys(new, 1))
        assert len(known) <= 17 and len(known.old) <= 17


def naive_sketch(t):
    h = text.shingles(text.word_hashes(t.encode())[0])
    return {int(x) for x in h if int(x) < 2**64 // fingerprint.SCALE}


def all_shingles(t):
    return set(text.shingles(text.word_hashes(t.encode())[0]).tolist())


def test_fingerprints(docs, texts):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.neighbours(one).collect()}
    order = sorted(texts)
    for i, d in enumerate(order):
        own, nxt = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + nxt[:half]
        r = got[d]
        assert r["n_chars"] == len(own) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = naive_sketch(own), naive_sketch(edited)
        assert len(base64.b64decode(r["fingerprint"])) == 5 * len(a)
        for name, text_, x in (("near_edited", edited, b), ("near_next", nxt, naive_sketch(nxt))):
            want = 0.0 if a or x else float(all_shingles(own) == all_shingles(text_))
            want = len(a & x) / min(len(a), len(x)) if a and x else want
            assert abs(r[name] - want) < 1e-12
    assert got[113]["fingerprint"] == got[114]["fingerprint"]


def test_fingerprints_with_repeats_and_nulls(docs, empty, spark):
    assert fingerprint.neighbours(docs).count() == docs.count()
    assert fingerprint.neighbours(empty).count() == 0
    lone = fingerprint.neighbours(spark.createDataFrame([(3, "a b c")], "doc_id long, text string")).first()
    assert lone["near_next"] == 1.0
    assert fingerprint.neighbours(spark.createDataFrame([(None, None), (None, "x")], "doc_id long, text string")).count() == 2


def test_sketches_merge():
    rng = np.random.default_rng(2)
    a, b = (np.unique(rng.integers(0, 2**40, 50).astype(np.uint64)) for _ in "ab")
    assert np.array_equal(fingerprint.unpack(fingerprint.pack(a)), a)
    assert fingerprint.containment(fingerprint.merge(a, b), b) == 1.0


def test_toxicity_held_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    tagger = toxicity.train(d, y)
    got = toxicity.score(d, tagger).join(y.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(y["doc_id"])).collect()
    hit = sum(r["predicted"] and r["toxic"] for r in got)
    # Outside English, the offending roots also occur by chance in about a tenth of the clean documents of this table.
    assert hit >= 0.8 * sum(r["toxic"] for r in got) and hit >= 0.85 * sum(r["predicted"] for r in got)
    assert all(r["spans"] for r in got if r["predicted"])


def test_toxicity_marginals_equal_enumeration():
    rng = np.random.default_rng(5)
    u, pairs = rng.normal(0, 1, 9), np.array([[0.0, -1.0], [0.5, 1.2]])
    ends = np.array([4, 9])
    got = toxicity.marginals(u, ends, pairs)
    at = 0
    for end in ends:
        x = u[at:end]
        total, toxic = 0.0, np.zeros(len(x))
        for k in range(1 << len(x)):
            tags = [k >> i & 1 for i in range(len(x))]
            w = np.exp(sum(s for s, t in zip(x, tags) if t) + sum(pairs[p, q] for p, q in zip(tags, tags[1:])))
            total += w
            toxic += w * np.array(tags)
        assert np.allclose(got[at:end], toxic / total)
        at = end


def test_toxicity_pair_counts_equal_enumeration():
    rng = np.random.default_rng(7)
    u, pairs = rng.normal(0, 1, 7), np.array([[0.0, -1.0], [0.5, 1.2]])
    ends = np.array([3, 7])
    want, at = np.zeros((2, 2)), 0
    for end in ends:
        x, total, counts = u[at:end], 0.0, np.zeros((2, 2))
        for k in range(1 << len(x)):
            tags = [k >> i & 1 for i in range(len(x))]
            w = np.exp(sum(s for s, t in zip(x, tags) if t) + sum(pairs[p, q] for p, q in zip(tags, tags[1:])))
            total += w
            for p, q in zip(tags, tags[1:]):
                counts[p, q] += w
        want += counts / total
        at = end
    assert np.allclose(toxicity.pair_counts(u, ends, pairs, *toxicity.messages(u, ends, pairs)), want)


def test_toxicity_spans_are_offsets(spark):
    tagger = toxicity.fit([(b"you are an idiot today", 1), (b"a fine day is today", 0)] * 20 + [(f"q{i} idiot r{i}".encode(), 1) for i in range(40)] + [(f"q{i} fine r{i}".encode(), 0) for i in range(40)])
    rows = [(1, "é well...idiot, (idiot) x/IDIOT day\n\t idiot"), (2, "a fine day"), (3, None)]
    got = {r["doc_id"]: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), tagger).collect()}
    assert [rows[0][1][s["start"] : s["end"]].lower() for s in got[1]["spans"]] == ["idiot"] * 4
    assert got[2]["spans"] == [] and got[3]["spans"] == [] and got[1]["predicted"] == 1 and got[2]["predicted"] == 0


def test_training_rows_are_bounded(spark):
    d = spark.createDataFrame([(i, "x" * 1000) for i in range(100)], "doc_id long, text string")
    y = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    assert len(toxicity.training_rows(d, y, most=30)) == 60
    for label in (0, 1):
        assert sum(v == label for _, v in toxicity.training_rows(d, y, most_bytes=20000)) == 10


def test_toxicity_blocks_join_up():
    rng = np.random.default_rng(6)
    u, pairs = rng.normal(-1, 2, 3000), np.array([[0.0, -1.0], [0.2, 1.0]])
    whole = toxicity.marginals(u, np.array([3000]), pairs)
    part = toxicity.marginals(u[:400], np.array([400]), pairs)
    assert np.allclose(whole[:300], part[:300], atol=1e-9)


def test_toxicity_odd_rows(docs, empty):
    tagger = toxicity.fit([(b"you idiot", 1), (b"fine day", 0)] * 20)
    assert toxicity.score(docs, tagger).count() == docs.count() and toxicity.score(empty, tagger).count() == 0
    assert toxicity.reject(docs, tagger).columns == docs.columns
    assert 0 <= toxicity.fit([]).document(np.zeros(1))[0] < 0.5
    r = {x["doc_id"]: x for x in toxicity.score(docs, tagger).collect()}
    assert r[110]["score"] == r[111]["score"]


def test_warc(spark, scratch):
    pages = [(1, "http://a/ b", "<p>x</p>"), (2, None, "<p>x</p>"), (3, "u", None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u\r\nX: y", "<p>x</p>"), (7, "u", "\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as sha", "2 as n")
    files = warc.archive(df, scratch.path("warc"), scratch)
    got = {r["page_id"]: r for r in warc.read(files).collect()}
    assert len(got) == len(pages)
    for page, _, html in pages:
        raw, r = (html or "").encode(), got[page]
        assert r["payload_bytes"] == len(raw) and r["payload_digest"] == warc.digest(raw)
        top = max(p for p, _, h in pages if (h or "") == (html or ""))
        assert (r["record_type"], r["refers_to"]) == (("response", None) if top == page else ("revisit", top))
        if top == page:
            assert bytes(r["payload"]) == raw
    assert warc.archive(df.limit(0), scratch.path("warc"), scratch).count() == 0


def test_warc_odd_rows(spark, scratch):
    rows = [(None, "u", "<p>long enough to be shared</p>"), (8, "u", "<p>long enough to be shared</p>"), (9, "v", "<p>long enough to be shared</p>"), (9, "v", "<p>long enough to be shared</p>"), (3, "w", "short"), (4, "w", "short")]
    files = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch.path("warc"), scratch, at_least=10)
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.read(files).collect())
    assert got == [(-1, "response", None), (3, "response", None), (4, "response", None), (8, "revisit", 9), (9, "response", None), (9, "response", None)]


def test_damaged_archives_are_told(spark, scratch, tmp_path):
    files = warc.archive(spark.createDataFrame([(i, "u", f"page {i} " * 50) for i in range(30)], "page_id long, url string, html string").coalesce(1), f"file://{tmp_path}", scratch)
    path = files.first()["path"].removeprefix("file://")
    raw = open(path, "rb").read()
    for bad in (raw[: len(raw) - 5], b"\0" * 20 + raw[20:], raw[:-40] + bytes(8) + raw[-32:]):
        open(path, "wb").write(bad)
        with pytest.raises(Exception):
            list(warc.records(path))


def test_warc_large_archive(spark, scratch):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, f"http://h/{i}", " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(2000))) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    files = warc.archive(df, scratch.path("warc"), scratch)
    assert warc.read(files).count() == 400
    fields, _ = next(iter(warc.records(files.first()["path"])))
    assert fields["WARC-Type"] == "response"


def test_licenses(spark, docs, empty):
    rows = [
        (1, "x\nReleased under the MIT License.\nAll rights reserved. all RIGHTS, reserved"),
        (2, "cc by cc by"), (3, None), (4, ""), (5, "Licensed under the Apache-License!! version 2.0 é"), (6, "general public"), (7, "license"), (7, "all rights reserved"),
    ]
    got = {}
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as s", "2 as label")).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert (got[1][0]["n_base"], got[1][0]["first_word"], got[1][0]["last_word"], got[1][0]["labels"]) == (2, 6, 9, "mit,reserved")
    assert (got[2][0]["n_base"], got[2][0]["n_words"], got[2][0]["last_word"]) == (2, 4, 2)
    assert got[3][0]["n_words"] == 0 and got[3][0]["first_word"] is None and got[4][0]["labels"] == ""
    assert got[5][0]["labels"] == "apache-2.0" and got[5][0]["base_labels"] == "" and got[6][0]["n_base"] == 0
    assert len(got[7]) == 2
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(docs).count() == docs.count()


def test_license_blocks_equal_brute_force(spark):
    rng = random.Random(4)
    vocabulary = sorted({w for _, _, ws in license_scan.templates() for w in ws}) + ["and", "q"]
    rows = [(i, "\n".join(" ".join(rng.sample(vocabulary, rng.randrange(4, 34)) if rng.random() < 0.3 else [w for w in rng.choice(license_scan.TEMPLATES)[1].split() if rng.random() < 0.93]) for _ in range(14))) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = set()
    for i, t in rows:
        w = t.split()
        for k, a in enumerate(range(0, max(1, len(w) - license_scan.STEP), license_scan.STEP)):
            for _, label, ws in license_scan.templates():
                both = len(set(ws) & set(w[a : a + license_scan.WIDTH]))
                if both >= license_scan.needed(len(ws)):
                    want.add((i, k, label, round(both / len(ws), 9)))
    got = {(r["doc_id"], r["block"], r["label"], round(r["share"], 9)) for r in license_scan.blocks(df, license_scan.frequencies(df)).collect()}
    assert got == want and len(want) > 30
    assert max(len(t.split()) for _, t in license_scan.TEMPLATES) <= license_scan.WIDTH - license_scan.STEP


def test_wrapped_licenses(spark):
    rng = random.Random(9)
    rows, want = [], {}
    for label, t in license_scan.TEMPLATES:
        w = t.split()
        for at in range(1, len(w)):
            want[len(rows)] = label
            rows.append((len(rows), f"Notes on it\n{' '.join(w[:at])}\n * {' '.join(w[at:])}, as before\nThe end"))
        want[len(rows)] = label
        rows.append((len(rows), "far " * 50 + "\r\n *\r\n".join(w) + " away" * 50))
    for _ in range(20):
        rows.append((len(rows), "\n".join(" ".join(rng.choice("the lines of a plain text under no terms at all".split()) for _ in range(9)) for _ in range(5))))
    got = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for d, _ in rows:
        if d in want:
            assert want[d] in got[d]["labels"].split(",") and got[d]["score"] == 1.0, rows[d]
        else:
            assert got[d]["labels"] == "" and got[d]["score"] == 0.0
