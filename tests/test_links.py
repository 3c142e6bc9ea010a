"""Links: references by RFC 3986, sites, odd anchors, ranks."""

from urllib.parse import urljoin

from pyspark.sql import functions as F

from eventide.functions import urls
from eventide.operators import links


def test_references(spark):
    base = "http://a/b/c/d;p?q"
    refs = ["g:h", "g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "g;x", "g;x?y#s", "", ".", "./", "..", "../", "../g", "../..", "../../", "../../g", "../../../g", "../../../../g", "/./g", "/../g", "g.", ".g", "g..", "..g", "./../g", "./g/.", "g/./h", "g/../h", "http://x/y/../z", "//h/a/./b?c"]
    rows = spark.createDataFrame([(k, r) for k, r in enumerate(refs)], "k int, ref string")
    got = [r.u for r in rows.orderBy("k").select(urls.resolved(F.col("ref"), F.lit(base)).alias("u")).collect()]
    want = [urljoin(base, r) for r in refs]
    want[14] = base  # the page itself
    want[refs.index("http://x/y/../z")], want[refs.index("//h/a/./b?c")] = "http://x/z", "http://h/a/b?c"  # dots go behind a host of its own, too
    assert got == want
    odd = spark.createDataFrame([("g", "http://a", "http://a/g"), ("g", None, None), (None, "http://a", None), ("g", "no address", None)], "ref string, base string, want string")
    assert all(r.got == r.want for r in odd.select(urls.resolved(F.col("ref"), F.col("base")).alias("got"), "want").collect())


def test_sites(spark):
    cases = [("https://www.example.org/x", "example.org"), ("http://a.b.example.co.uk:80/", "example.co.uk"), ("https://u:p@Shop.Example.com", "example.com"), ("https://localhost/", "localhost"), ("https://co.uk", "co.uk"), ("", "")]
    rows = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], "k int, url string, want string")
    assert all(r.got == r.want for r in rows.select(urls.site(F.col("url")).alias("got"), "want").collect())
    rows = spark.createDataFrame([("https://a.org/e/c/2026/x", "https://a.org/e/c/2026/y", False), ("https://a.org/e/c/2026/x", "https://a.org/e/other", True), ("https://a.org/e/x", "https://a.org/z", False), ("https://a.org/e/c/2026/x", "https://b.org/z", False)], "base string, url string, want boolean")
    assert all(r.got == r.want for r in rows.select(urls.outside(F.col("url"), F.col("base")).alias("got"), "want").collect())


def test_ranks(spark):
    html = """<a href="/about">About us</a><A class=x HREF='fees-2026.html#top'>What it <b>costs</b></A><a href=register?a=1&amp;b=2>Go</a><a href="/news">Subscribe to fees</a><a href="#fees">Fees</a><a href="mailto:x@y">Register</a>
    <!-- <a href="/register">no</a> --><a name=x>Fees</a><a href="https://other.example.org/fees">Fees</a><a href="/a/fees-2026.html">again</a><a href="https://www.example.com/tickets">Tickets<a href="/a/">Register here</a>"""
    pages = spark.createDataFrame([(1, "https://example.com/a/", html), (2, None, html), (3, "https://example.com", None), (4, "https://example.com/x", '<base href="/deep/"><a href="prices">x</a>')], "page_id long, url string, html string")
    found = links.links(pages)
    assert [(r.href, r.url, r.same_site) for r in found.filter("page_id = 1").orderBy("place").collect()][:3] == [("/about", "https://example.com/about", True), ("fees-2026.html#top", "https://example.com/a/fees-2026.html#top", True), ("register?a=1&b=2", "https://example.com/a/register?a=1&b=2", True)]
    got = links.ranked(found, ["(?i)fees?|costs?|prices", links.REGISTRATION], k=3).orderBy("page_id", "rank").collect()
    assert [(r.page_id, r.rank, r.url) for r in got] == [(1, 1, "https://example.com/a/fees-2026.html"), (1, 2, "https://example.com/a/register?a=1&b=2"), (1, 3, "https://www.example.com/tickets"), (4, 1, "https://example.com/deep/prices")]
