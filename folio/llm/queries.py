"""The thin queries of the operators over their whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm import fingerprint, license_scan, line_dedup, media, near_dedup, packing, spm, substring_dedup, toxicity, warc
from folio.llm.scratch import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def line_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.similar_lines(table(spark, sf_dir, "documents"), Scratch(spark))


def warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    files = warc.archive(table(spark, sf_dir, "pages"), scratch.path("warc"), scratch)
    each = files.repartitionByRange(max(1, files.count()), "path")  # one archive a task
    return warc.read(each).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")
    back = spm.decode(spm.encode(docs, path), path)
    return back.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.crc32(F.array_join("ids", " ").cast("binary")).alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


def license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeats(table(spark, sf_dir, "documents"), Scratch(spark))


def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.neighbours(table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, tagger).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_all(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), Scratch(spark))


def media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    path = scratch.path("media")
    media.store(table(spark, sf_dir, "documents")).write.option("compression", "zstd").parquet(path)
    return media.probe(spark.read.parquet(path)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "frame_offsets")


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), Scratch(spark))


QUERIES = {
    "op1_line_dedup": line_classes,
    "op2_warc": warc_archive,
    "op3_sentencepiece": sentencepiece,
    "op4_licenses": license_labels,
    "op5_substring_dedup": repeated_passages,
    "op6_fingerprints": fingerprints,
    "op7_toxicity": toxicity_scores,
    "op8_packing": best_fit_packing,
    "op9_media": media_columns,
    "op10_near_dedup": near_duplicates,
}

_BASE32 = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, %d, 5))::BIGINT >> %d) & 31 AS BIGINT), 1)" % (5 * i + 1, s) for i in range(8) for s in (15, 10, 5, 0)
)

_TEMPLATES = ", ".join(f"({number}, '{label}', {words!r}, {license_scan.needed(len(words))})" for number, label, words in license_scan.templates())
_PHRASES = ", ".join(f"({phrase.split()!r}, '{label}')" for phrase, label in license_scan.BASE)

SQL = {
    "op1_line_dedup": r"""
WITH RECURSIVE l AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line, unnest(l) AS t FROM (
    SELECT doc_id, string_split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10)) AS l FROM documents)),
s AS (SELECT doc_id, line, list_sort(list_distinct(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))) AS s FROM l),
o AS (SELECT s, doc_id, line, row_number() OVER (ORDER BY doc_id, line) AS pos FROM s WHERE len(s) > 0),
c AS (SELECT s, min(pos) AS v, count(*) AS n, len(s) AS k FROM o GROUP BY s),
w AS (SELECT v, k, unnest(s) AS w FROM c),
f AS (SELECT w, count(*) AS f FROM w GROUP BY w),
p AS (SELECT v, k, w, row_number() OVER (PARTITION BY v ORDER BY f, w) - 1 AS i FROM w JOIN f USING (w)),
x AS (SELECT DISTINCT a.v AS a, b.v AS b FROM p a JOIN p b ON a.w = b.w AND a.v < b.v AND 4 * least(a.k, b.k) >= 3 * greatest(a.k, b.k) AND a.i <= a.k // 4 AND b.i <= b.k // 4),
y AS (SELECT a, b FROM x JOIN c ca ON ca.v = a JOIN c cb ON cb.v = b WHERE 7 * len(list_intersect(ca.s, cb.s)) >= 3 * (ca.k + cb.k)),
e AS (SELECT a, b FROM y UNION ALL SELECT b, a FROM y),
r AS (SELECT v, v AS u FROM c WHERE n > 1 OR v IN (SELECT a FROM e) UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u),
g AS (SELECT v, min(u) AS class FROM r GROUP BY v),
d AS (SELECT a AS v, count(*) AS n_links, min(b) AS near FROM e GROUP BY a)
SELECT o.doc_id, o.line::INT AS line, h.doc_id AS class_doc_id, h.line::INT AS class_line, coalesce(d.n_links, 0)::BIGINT AS n_links, m.doc_id AS match_doc_id, m.line::INT AS match_line
FROM o JOIN c USING (s) JOIN g ON g.v = c.v LEFT JOIN d ON d.v = c.v JOIN o h ON h.pos = g.class
LEFT JOIN o m ON m.pos = least(CASE WHEN c.v < o.pos THEN c.v END, CASE WHEN d.near < o.pos THEN d.near END)""",
    "op4_licenses": rf"""
WITH w AS (SELECT row_number() OVER () AS nth, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
h AS (SELECT nth, label, unnest(list_filter(range(0, len(w) - len(phrase) + 1), lambda i: list_slice(w, i + 1, i + len(phrase)) = phrase)) AS pos FROM w, (VALUES {_PHRASES}) AS p(phrase, label)),
b AS (SELECT doc_id, list_distinct(list_slice(w, s + 1, s + {license_scan.WIDTH})) AS b FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - {license_scan.STEP} - 1, 0) + 1, {license_scan.STEP})) AS s FROM w)),
m AS (SELECT doc_id, label, len(list_intersect(b, words)) / len(words) AS share FROM b, (VALUES {_TEMPLATES}) AS t(number, label, words, need) WHERE len(list_intersect(b, words)) >= need),
n AS (SELECT nth, count(*) AS n, min(pos) AS first, max(pos) AS last, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY nth),
s AS (SELECT doc_id, max(share) AS share FROM m GROUP BY doc_id),
a AS (SELECT nth, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT nth, label FROM h UNION SELECT nth, label FROM w JOIN m USING (doc_id)) GROUP BY nth)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, first AS first_word, last AS last_word, coalesce(n.labels, '') AS base_labels, coalesce(a.labels, '') AS labels,
  CASE WHEN n > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN n USING (nth) LEFT JOIN a USING (nth) LEFT JOIN s USING (doc_id)""",
    "op2_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (h)""",
    "op10_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * x >= 75 * (na.n + nb.n - x)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.b FROM r JOIN e ON e.a = r.u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.c AS component_id, d.doc_id = c.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT v, min(u) AS c FROM r GROUP BY v) c ON c.v = d.doc_id""",
}
