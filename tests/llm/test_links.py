"""Links between pages: attributes one by one, base elements, broken markup of any length; the query against its SQL."""

import time

import duckdb
import pytest

from plumbline.llm import url_filter


CASES = [
    ('<link title="a>b" rel=canonical href="/x">', "http://a.com/x"),
    ("<LINK REL='nofollow Canonical' HREF = '/x'>", "http://a.com/x"),
    ('<link data-rel="canonical" href="/x">', None),
    ('<link rel=alternate title="rel=canonical" href="/x">', None),
    ('<link rel=canonical data-href="/y" href="/x">', "http://a.com/x"),
    ('<link rel="canonical" href="/x" href="/y">', "http://a.com/x"),
    ("<link rel=canonical href=it's>", "http://a.com/d/it"),
    ('<base href="http://b.org/q/z"><link rel=canonical href="x">', "http://b.org/q/x"),
    ('<base target=_top><base href="/up/"><link rel=canonical href="../x">', "http://a.com/x"),
    ('<meta http-equiv="refresh" content="0; url=/x">', "http://a.com/x"),
    ("<meta content='3;URL=&quot;/x&quot;' http-equiv=Refresh>", "http://a.com/x"),
    ('<meta name="note" content="http-equiv=refresh url=/x">', None),
    ("<link rel=canonical <p>href=/x>", None),
    ("<linkage rel=canonical href=/x>", None),
    ('<link/rel="canonical"/href="/x"/>', "http://a.com/x"),
    ("<!-- <link rel=canonical href=/x> -->", None),
]


def test_links(spark):
    df = spark.createDataFrame([(f"http://a.com/d/p?{k}", html) for k, (html, _) in enumerate(CASES)], "url string, html string")
    got = {int(r.url.rpartition("?")[2]): r.target for r in url_filter.links(df).collect()}
    assert {k: got.get(k) for k in range(len(CASES))} == {k: target for k, (_, target) in enumerate(CASES)}


def test_broken_markup_takes_no_long(spark):
    """A megabyte each of tags that do not end."""
    pieces = ["<link ", '<link a="', "<link rel=canonical '", "<meta content=\"'", "<base href='", "<!--", "<script>", "<link rel=canonical href=x "]
    pages = spark.createDataFrame([("http://a.com/", "canonical " + p * (1_000_000 // len(p))) for p in pieces], "url string, html string").repartition(4).cache()
    pages.count()
    began = time.time()
    url_filter.links(pages).collect()
    assert time.time() - began < 30
    pages.unpersist()


def test_query_and_sql(spark):
    folder = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{folder}/pages.parquet'")
    rel = c.sql(url_filter.SQL)
    got = url_filter.op1_url_filter(spark, folder).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.fetchall(), key=repr)


def test_sql_parses_attributes_too(spark, tmp_path):
    pages = ['<link title="a>b" rel=canonical href="http://x.org/fr/1">', '<base href="http://x.org/fr/"><link rel=canonical href=2>', '<link data-rel=canonical href="http://x.org/fr/3">', '<link rel=alternate title="rel=canonical" href="http://x.org/fr/4">']
    rows = [(k, f"http://s.com/p{k}", html) for k, html in enumerate(pages)] + [(9, "http://x.org/fr/3", None)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    rel = c.sql(url_filter.SQL)
    got = url_filter.op1_url_filter(spark, str(tmp_path)).select(*rel.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(rel.fetchall(), key=repr)
    assert url_filter.links(spark.createDataFrame(rows, "page_id long, url string, html string")).count() == 2
