"""Queries over the document operators, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folio.functions import text as fn
from folio.operators.split import split_documents
from folio.operators.structure import soft_wraps
from folio.plans.splitting import Options

PLAIN = Options(500, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt over the cores before a Python operator: a driver table is one file."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_documents(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), PLAIN, keep=["doc_id", "lang"])


def chunk_stats_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("chunks"), F.max("length").cast("long").alias("longest"), F.sum(F.col("length").cast("long")).alias("code_points"))


def chunk_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.col("length").cast("long").alias("length"), "text")


def chunk_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text from its chunks: what follows the previous chunk's end, in order."""
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    new = F.substring(F.col("text").cast("binary"), F.coalesce(F.lag("end").over(w), F.lit(0)) - F.col("start") + 1, F.col("end"))
    parts = chunks(spark, sf_dir).select("doc_id", "chunk_no", F.decode(new, "UTF-8").alias("new"))
    return parts.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "new"))), lambda x: x["new"]), "").alias("text"))


def chunk_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the splitter's promises by document: all are 0."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("whole"))
    w = Window.partitionBy("doc_id").orderBy("chunk_no")
    rows = chunks(spark, sf_dir).join(docs, "doc_id").withColumns({"before": F.lag("end").over(w), "first": F.lag("start").over(w), "after": F.lead("end").over(w)})
    raw = F.col("whole").cast("binary")
    bad = {
        "gaps": F.when(F.col("start") > F.coalesce("before", F.lit(0)), 1),
        "disorder": F.when((F.col("start") <= F.col("first")) | (F.col("end") <= F.col("before")), 1),
        "too_long": F.when(F.col("length") > PLAIN.max_size, 1),
        "not_a_slice": F.when(F.substring(raw, F.col("start") + 1, F.col("end") - F.col("start")) != F.col("text").cast("binary"), 1),
        "unfinished": F.when(F.col("after").isNull() & (F.col("end") != F.octet_length("whole")), 1),
        "overlaps": F.when(fn.measured_length(F.decode(F.substring(raw, F.col("start") + 1, F.greatest(F.col("before") - F.col("start"), F.lit(0))), "UTF-8")) > PLAIN.overlap, 1),
    }
    return rows.groupBy("doc_id").agg(*[F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(k) for k, c in bad.items()])


def heading_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations under their regions as one Markdown text, split at every heading: each body's path and context."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    part = F.concat(F.lit("## "), "n_name", F.lit("\n\nNation "), "n_name", F.lit(" has key "), "n_nationkey", F.lit(".\n"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", part.alias("md")))), lambda x: x["md"]), "\n")
    docs = nations.groupBy("r_regionkey", "r_name").agg(body.alias("body")).select(F.col("r_regionkey").cast("long").alias("doc_id"), F.concat(F.lit("# "), "r_name", F.lit("\n\nA region.\n\n"), "body").alias("text"))
    rows = split_documents(docs, Options(200, 0)).where("chunk_no > 0")
    return rows.select("doc_id", F.col("chunk_no").cast("long").alias("chunk_no"), F.array_join(F.transform("headings", lambda h: h["text"]), " > ").alias("path"), fn.text_with_context(F.trim(F.col("text")), F.col("headings"), F.col("table_header")).alias("with_context"))


def text_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    crlf = F.replace(t, F.lit("\n"), F.lit("\r\n"))
    return table(spark, sf_dir, "documents").select("doc_id", fn.measured_length(t).alias("measured"), fn.measured_length(crlf).alias("measured_crlf"), F.octet_length(t).cast("long").alias("bytes"))


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.concat(F.lit("﻿"), F.replace(F.replace(F.col("text"), F.lit("\n"), F.lit("\r\n")), F.lit(" the "), F.lit(" \0the ")))
    return table(spark, sf_dir, "documents").select("doc_id", fn.normalized(odd).alias("text"))


def format_of_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.col("url"), F.get(F.array(*[F.lit(x) for x in ("/a.HTM", "/b.tar.Markdown", "/.hidden", "/c.", "\\d.yml", "/e", "/f.text")]), (F.col("page_id") % 7).cast("int")))
    return table(spark, sf_dir, "pages").select("page_id", fn.format_of(name).alias("format"))


def source_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(fn.within_limit(F.col("text"), 4096), None).otherwise("source limit of 4096 exceeded").alias("error"))


def json_fence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", fn.fenced(F.col("props"), "json").alias("markdown"))


def fence_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    ticks = F.concat("text", F.repeat(F.lit("`"), (F.col("doc_id") % 6).cast("int")), F.lit(" x ``"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(F.regexp_extract(fn.fenced(ticks), "^(`+)", 1)).cast("long").alias("fence"))


MARKERS = ("# a", "> b", "- c", "+ d", "* e", "= f", "| g", "` h", "~ i", "< j", "_ k", "12. l", "3) m", "1234567890. n", "plain", "  - o", "\t# p")


def paragraph_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.get(F.array(*[F.lit(m) for m in MARKERS]), (F.col("p_partkey") % len(MARKERS)).cast("int")), F.lit(" "), "p_name", F.lit("\r\n"), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", fn.paragraph(line).alias("markdown"))


def cell_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", fn.cell(F.concat(F.lit(" \t a|b\\ "), "p_name", F.lit("\n\n c "))).alias("cell"))


def nation_rows() -> Column:
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return F.concat(F.array(F.array(F.lit("key"), F.lit("name"), F.lit("no|te"))), rows)


def gfm_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(nation_rows().alias("rows"))
    return rows.select("n_regionkey", fn.gfm_table(F.col("rows")).alias("markdown"), fn.gfm_table_size(F.col("rows")).alias("bytes"))


def wraps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line breaks that only wrap a sentence, by document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", soft_wraps(F.col("text")).alias("wraps"))


#: Characters of a window of sections, and ids of a run whose lengths are summed first.
WINDOW, RUN = 5000, 4096


def sections_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a source laid end to end as sections, and which of them each window of 5,000 characters meets.

    Running sums are taken of runs of ids and then within each, so that no task holds a
    whole source; sections go to the windows that they touch, which a window's group
    bounds.
    """
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n"), F.floor(F.col("doc_id") / RUN).alias("run"))
    upto = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    runs = docs.groupBy("source", "run").agg(F.sum(F.col("n") + 2).alias("size"))
    runs = runs.withColumn("base", F.coalesce(F.sum("size").over(upto("source").orderBy("run")), F.lit(0)))
    inner = F.coalesce(F.sum(F.col("n") + 2).over(upto("source", "run").orderBy("doc_id")), F.lit(0))
    start = F.col("base") + F.col("inner")
    laid = docs.withColumn("inner", inner).join(runs, ["source", "run"]).select("source", "doc_id", start.alias("start"), (start + F.col("n")).alias("end"))
    total = laid.groupBy("source").agg(F.max("end").alias("total"))
    at = lambda a, b: F.explode(F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>")))
    number = lambda c: F.floor(c / WINDOW).cast("long")
    touched = laid.where("start < end").select("source", at(number(F.col("start")), number(F.col("end") - 1)).alias("w"), F.struct("start", "doc_id").alias("s"))
    every = laid.join(total, "source").select("source", at(number(F.col("start") + WINDOW - 1), number(F.least(F.col("end") + 1, "total"))).alias("w"), F.lit(None).cast("struct<start: bigint, doc_id: bigint>").alias("s"))
    met = touched.unionByName(every).groupBy("source", "w").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return met.select("source", (F.col("w") * WINDOW).alias("at"), F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: x["doc_id"].cast("string")), ",").alias("doc_ids"))


QUERIES = {
    "chunk_stats_by_lang": chunk_stats_by_lang,
    "chunk_exact": chunk_exact,
    "chunk_rebuild": chunk_rebuild,
    "chunk_contract": chunk_contract,
    "heading_paths": heading_paths,
    "text_lengths": text_lengths,
    "normalize_text": normalize_text,
    "format_of_url": format_of_url,
    "source_limit": source_limit,
    "json_fence": json_fence,
    "fence_length": fence_length,
    "paragraph_escape": paragraph_escape,
    "cell_escape": cell_escape,
    "gfm_table": gfm_table,
    "soft_wraps": wraps,
    "sections_in": sections_in,
}

#: The splitter on texts of plain lines: candidate positions with ranks by stretches of a text, and from each start the best of those near. A recursive query.
_S, _O, _M = PLAIN.size, PLAIN.overlap, PLAIN.max_size
_CHUNKS = rf"""
d AS MATERIALIZED (SELECT doc_id, lang, text, length(text) AS n, string_split(text, chr(10)) AS l, length(rtrim(text, ' ' || chr(10) || chr(9))) AS last FROM documents WHERE trim(text, ' ' || chr(10) || chr(9)) <> ''),
ln AS (SELECT doc_id, k, l[k] AS x, CASE WHEN k > 1 THEN l[k - 1] END AS before FROM d, unnest(range(1, len(l) + 1)) AS t(k)),
la AS MATERIALIZED (SELECT *, coalesce(sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a FROM ln),
w AS (SELECT doc_id, a, string_split(replace(x, chr(9), ' '), ' ') AS w FROM la),
e AS (SELECT doc_id, a, i, w[i] AS y, length(w[i]) + 1 AS size FROM w, unnest(range(1, len(w))) AS t(i)),
sp AS (SELECT doc_id, y, a + sum(size) OVER (PARTITION BY doc_id, a ORDER BY i)::BIGINT AS p FROM e),
c AS MATERIALIZED (
  SELECT doc_id, p, p // {_M} AS m, CASE WHEN y[-1] IN ('.', '!', '?') THEN 4 WHEN y[-1] IN (',', ';') THEN 3 ELSE 2 END AS r FROM sp
  UNION ALL
  SELECT doc_id, a, a // {_M}, CASE WHEN NOT regexp_matches(before, '(  |\\)$') AND regexp_matches(before, '[\p{{L}}\p{{N}}][ \t]*$') AND regexp_matches(x, '^[ \t]*[\p{{L}}\p{{N}},.;:!?)]') THEN 2 ELSE 5 END FROM la WHERE k > 1),
s AS MATERIALIZED (SELECT doc_id, m, list({{'p': p, 'r': r}} ORDER BY p) AS c FROM c GROUP BY doc_id, m),
near AS MATERIALIZED (SELECT d.doc_id, d.n, d.last, d.text, x.m, coalesce(a.c, []) || coalesce(b.c, []) AS ahead, coalesce(z.c, []) || coalesce(a.c, []) AS behind
  FROM d, unnest(range(0, d.n // {_M} + 1)) AS x(m) LEFT JOIN s a ON a.doc_id = d.doc_id AND a.m = x.m LEFT JOIN s b ON b.doc_id = d.doc_id AND b.m = x.m + 1 LEFT JOIN s z ON z.doc_id = d.doc_id AND z.m = x.m - 1),
k AS (
  SELECT doc_id, 0::BIGINT AS no, 0::BIGINT AS a, NULL::BIGINT AS b FROM d
  UNION ALL
  SELECT doc_id, CASE WHEN b IS NULL THEN no ELSE no + 1 END, CASE WHEN b IS NULL THEN a ELSE nxt END, CASE WHEN b IS NULL THEN cut END FROM (
    SELECT doc_id, no, a, b,
      CASE WHEN b IS NOT NULL THEN NULL WHEN n - a <= {_M} THEN n ELSE coalesce(
        -(list_max(list_transform(list_filter(ahead, lambda x: x.p >= a + {max(_O + 1, _S // 2)} AND x.p <= a + {_S} AND n - x.p > {_M - _S} AND x.p < last), lambda x: {{'r': x.r, 'd': -abs(x.p - a - target), 'p': -x.p}})).p),
        -(list_max(list_transform(list_filter(ahead, lambda x: x.p >= a + {max(_O + 1, _S // 2)} AND x.p <= a + {_M} AND x.p < last), lambda x: {{'r': x.r, 'd': -abs(x.p - a - target), 'p': -x.p}})).p)) END::BIGINT AS cut,
      CASE WHEN b IS NULL THEN NULL WHEN b - {_O} <= a THEN b ELSE coalesce(-(list_max(list_transform(list_filter(behind, lambda x: x.p >= b - {_O} AND x.p < solid), lambda x: {{'r': x.r, 'p': -x.p}})).p), b) END::BIGINT AS nxt
    FROM (SELECT k.*, near.n, near.last, near.ahead, near.behind, length(rtrim(near.text[1:k.b], ' ' || chr(10) || chr(9))) AS solid,
        ceil((near.n - k.a + (ceil((near.n - k.a - {_O}) / {_S - _O}) - 1) * {_O}) / ceil((near.n - k.a - {_O}) / {_S - _O})) AS target
      FROM k JOIN near ON near.doc_id = k.doc_id AND near.m = coalesce(k.b, k.a) // {_M}) q
    WHERE b IS NULL OR b < n) y),
chunks AS (SELECT k.doc_id, d.lang, k.no AS chunk_no, k.b - k.a AS length, d.text[k.a + 1:k.b] AS text FROM k JOIN d USING (doc_id) WHERE k.b IS NOT NULL)
"""

_MARKERS = ", ".join("'" + m.replace("\t", "' || chr(9) || '") + "'" for m in MARKERS)

SQL = {
    "chunk_exact": f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, chunk_no, length, text FROM chunks",
    "chunk_stats_by_lang": f"WITH RECURSIVE {_CHUNKS} SELECT lang, count(*)::BIGINT AS chunks, max(length)::BIGINT AS longest, sum(length)::BIGINT AS code_points FROM chunks GROUP BY lang",
    "chunk_rebuild": "SELECT doc_id, text FROM documents WHERE trim(text, ' ' || chr(10)) <> ''",
    "chunk_contract": "SELECT doc_id, 0::BIGINT AS gaps, 0::BIGINT AS disorder, 0::BIGINT AS too_long, 0::BIGINT AS not_a_slice, 0::BIGINT AS unfinished, 0::BIGINT AS overlaps FROM documents WHERE trim(text, ' ' || chr(10)) <> ''",
    "heading_paths": """
SELECT n_regionkey::BIGINT AS doc_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey)::BIGINT AS chunk_no, r_name AS path,
  r_name || chr(10) || chr(10) || '## ' || n_name || chr(10) || chr(10) || 'Nation ' || n_name || ' has key ' || n_nationkey || '.' || chr(10)
  || CASE WHEN n_nationkey = max(n_nationkey) OVER (PARTITION BY n_regionkey) THEN '' ELSE chr(10) END AS with_context
FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "text_lengths": "SELECT doc_id, length(replace(text, chr(13) || chr(10), chr(10)))::BIGINT AS measured, length(text)::BIGINT AS measured_crlf, strlen(text)::BIGINT AS bytes FROM documents",
    "normalize_text": "SELECT doc_id, text FROM documents",
    "format_of_url": "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'html' WHEN 1 THEN 'md' WHEN 4 THEN 'yaml' WHEN 6 THEN 'txt' END AS format FROM pages",
    "source_limit": "SELECT doc_id, CASE WHEN strlen(text) > 4096 THEN 'source limit of 4096 exceeded' END AS error FROM documents",
    "json_fence": "SELECT event_id, '```json' || chr(10) || props || chr(10) || '```' AS markdown FROM events",
    "fence_length": "SELECT doc_id, greatest(3, 1 + list_max(list_transform(regexp_extract_all(text || repeat('`', (doc_id % 6)::INT) || ' x ``', '`+'), lambda x: length(x))))::BIGINT AS fence FROM documents",
    "paragraph_escape": f"""
WITH t AS (SELECT p_partkey, ltrim(([{_MARKERS}])[1 + p_partkey % {len(MARKERS)}], ' ' || chr(9)) || ' ' || p_name AS a, p_name FROM part)
SELECT p_partkey, CASE WHEN regexp_matches(a, '^[#>+*=|`~<_-]') THEN '\\' || a
  WHEN regexp_matches(a, '^[0-9]{{1,9}}[.)]') THEN regexp_replace(a, '^([0-9]+)', '\\1\\\\') ELSE a END || chr(10) || p_name AS markdown FROM t""",
    "cell_escape": "SELECT p_partkey, 'a\\|b\\\\ ' || p_name || ' c' AS cell FROM part",
    "gfm_table": """
WITH t AS (SELECT n_regionkey, '| key | name | no\\|te |' || chr(10) || '| --- | --- | --- |' || chr(10)
  || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |  |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY 1)
SELECT n_regionkey, markdown, strlen(markdown)::BIGINT AS bytes FROM t""",
    "soft_wraps": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)
SELECT doc_id, len(list_filter(range(1, len(l)), lambda i: NOT regexp_matches(l[i], '(  |\\)$') AND regexp_matches(l[i], '[\p{L}\p{N}][ \t]*$')
  AND regexp_matches(l[i + 1], '^[ \t]*[\p{L}\p{N},.;:!?)]')))::BIGINT AS wraps FROM l""",
    "sections_in": """
WITH d AS (SELECT source, doc_id, coalesce(sum(length(text) + 2) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s, length(text) AS n FROM documents),
w AS (SELECT source, unnest(range(0, max(s + n)::BIGINT + 1, 5000)) AS at FROM d GROUP BY source)
SELECT w.source, w.at, count(d.doc_id)::BIGINT AS n, coalesce(string_agg(d.doc_id::VARCHAR, ',' ORDER BY d.s, d.doc_id), '') AS doc_ids
FROM w LEFT JOIN d ON d.source = w.source AND d.n > 0 AND d.s < w.at + 5000 AND w.at < d.s + d.n GROUP BY 1, 2""",
}

def entry(spark: SparkSession) -> DataFrame:
    return chunk_stats_by_lang(spark, "/root/testdata/sf0.001")
