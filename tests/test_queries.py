"""Every query with SQL gives the rows that DuckDB gives, column by column."""

import os

import duckdb
import pytest

from folio import conversions, queries

SF = "/root/testdata/sf0.001"
QUERIES, SQL = queries.QUERIES | conversions.QUERIES, queries.SQL | conversions.SQL


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(name, spark, db):
    got, want = QUERIES[name](spark, SF), db.sql(SQL[name])
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    plain = lambda rows, names: sorted((repr(tuple(r[names.index(c)] for c in cols)) for r in rows))
    assert plain([tuple(r) for r in got.collect()], got.columns) == plain(want.fetchall(), list(want.columns))


HEADINGS = {
    "cut reference": "<h1>a &amp;&amp; b&amp</h1>",
    "cut earlier": "<h1>a &lt;&am</h1><p>&amp</p>",
    "all four cut": "<h1>&lt &gt &quot &amp x</h1>",
    "cut and run on": "<h1>&ltx &ampamp; &quota AT&T</h1>",
    "other references": "<h1>&copy; &notit; &#39; &#x27 &nbsp;x</h1>",
    "read once": "<h1>&amp;lt; &amp;amp; &amp;amp &quot;q&quot; &amp;copy;</h1>",
    "read and escaped": "<h1>1 &lt;b&gt; *c* _d_ `e` [f] \\g</h1>",
    "another charset": '<meta charset="windows-1252"><h1>Äé &amp</h1>',
    "code before": "<pre># x</pre><p>```</p><pre>\n```\n# y\n```</pre><h1>a</h1>",
    "ticks before": "<p><code>a``b</code></p><h1>a</h1><pre># x</pre>",
    "code alone": "<pre># x</pre>",
    "odd line ends": "<p>x\u2028# y</p><h1>a</h1>",
    "over the source limit": "<h1>a &amp</h1><!--" + "&" * (8 << 20) + "-->",
    "empty": "",
    "null": None,
}


def test_html_headings_of_odd_pages_equal_their_sql(spark, tmp_path):
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, name VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", [(k, *x) for k, x in enumerate(HEADINGS.items())])
    con.sql(f"COPY pages TO '{tmp_path}/pages.parquet'")
    got = {r["page_id"]: r["heading"] for r in QUERIES["html_headings"](spark, str(tmp_path)).collect()}
    assert {n: got[k] for k, n in enumerate(HEADINGS)} == {n: h for n, h in con.sql(f"SELECT name, heading FROM ({SQL['html_headings']}) JOIN pages USING (page_id)").fetchall()}
