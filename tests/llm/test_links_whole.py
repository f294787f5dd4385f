"""Relative links mean the address that RFC 3986 gives them, and such an alias of a blocked page is blocked."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from itemforge.llm import url_filters

BASES = ["http://a.org/b/c/d?q=1", "http://a.org", "http://a.org/b/", "http://a.org/b"]
LINKS = ["../x", "./x", "../../x", "../../../x", "x/../y", "x/./y", "..", ".", "./", "../", "?y=2", "?y=../z", "/x/../y", "/./x", "x?u=../z", "//o.org", "x", "/x", "..x/y.", "/x/.."]


def test_relative_links(spark):
    pairs = [(b, h) for b in BASES for h in LINKS]
    rows = spark.createDataFrame(pairs, "b string, h string").select("b", "h", url_filters.address(url_filters.resolve(F.col("h"), F.col("b"))).alias("to")).collect()
    for r in rows:
        want = urljoin(r["b"], r["h"]).split("://")[1]
        assert r["to"] == (want if "/" in want.split("?")[0] else want + "/" if "?" not in want else want.replace("?", "/?", 1)), tuple(r)
    # urljoin leaves the dots of a link with a host, and drops empty segments
    assert spark.range(1).select(url_filters.address(url_filters.resolve(F.lit("a//../b"), F.lit(BASES[0])))).first()[0] == "a.org/b/c/a/b"
    assert spark.range(1).select(url_filters.address(url_filters.resolve(F.lit("//o.org/p/../q"), F.lit(BASES[0])))).first()[0] == "o.org/q"


def test_aliases_by_relative_links(spark):
    blocked = '<link rel="canonical" href="http://example.com/en/1">'
    pages = [
        (1, "http://a.org/x/y", blocked), (2, "http://a.org/x/z/w", '<link rel="canonical" href="../y">'),
        (3, "http://b.org/p?k=1", blocked), (4, "http://b.org/p", '<link rel="canonical" href="?k=1">'), (5, "http://c.org/q/r", '<meta http-equiv="refresh" content="0; url=../../c">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow"}
