"""HTML text, links, URLs and categories on hand-made inputs."""

from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from sitegauge.functions import html as H
from sitegauge.functions.rules import link_category, range_label, revenue_class
from sitegauge.functions.urls import is_file_link, resolve_url, url_netloc
from sitegauge.operators import pages


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


class Reader(HTMLParser):
    """Reference reading of well-formed pages."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hidden, self.parts = [], []

    def handle_starttag(self, tag, attrs):
        if tag in H.DROPPED_ELEMENTS:
            self.hidden.append(tag)

    def handle_endtag(self, tag):
        if self.hidden and self.hidden[-1] == tag:
            self.hidden.pop()

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


PAGES = [
    "<html><head><title>T &amp; U</title><style>p{}</style></head><body><p>a<b>b</b>c</p></body></html>",
    "<body><!-- <script> --><p>kept</p><!-- </script> --><nav>x<a href='/y'>y</a></nav>z</body>",
    "<p>1 &lt; 2 &amp;&amp; 3 &gt; 2</p><script>if (a < b) { document.write('<p>no</p>') }</script>",
    '<p title="a > b">text</p><form><input value="&quot;"></form> 　 spaced out &nbsp; end',
    "<header>h</header><main>日本語&#12354;&#x3042;テキスト</main><footer>f</footer><aside>s</aside>",
    "x < y and <b>bold</b> &copy; &unknown; & plain",
    "",
]


@pytest.mark.parametrize("page", PAGES)
def test_text_agrees_with_a_parser(spark, page):
    reader = Reader()
    reader.feed(page)
    reader.close()
    want = " ".join(" ".join(reader.parts).split())
    assert one(spark, page, H.html_text) == want


def test_references_decode_once(spark):
    assert one(spark, "&amp;lt; &eacute;&#128512;&#0;&apos;", H.unescape) == "&lt; é😀�'"


def test_long_hidden_block_does_not_overflow(spark):
    page = "<p>a</p><nav>" + "<li><a href='/x'>y</a></li>" * 20_000 + "</nav><p>b</p>"
    assert one(spark, page, H.html_text) == "a b"


LINKS = ["/z", "z", "../z", "./z", "../../z?a=../b", "//o.jp/k", "?p=2", "#top", "https://q.com/", "/a/../b", "..", ".", "z/.."]


def test_urls_resolve_like_the_standard(spark):
    bases = ["http://a.jp/x/y.html?q=1#f", "https://a.jp:8080/x/", "http://a.jp"]
    pairs = [(b, h) for b in bases for h in LINKS if not (b == "http://a.jp" and h == "..")]
    got = spark.createDataFrame(pairs, "b string, h string").select("b", "h", resolve_url(F.col("b"), F.col("h")).alias("r"))
    for row in got.collect():
        want = urljoin(row.b, row.h)
        assert row.r in (want, want + "/"), (row, want)


def test_url_parts(spark):
    assert one(spark, "https://u:p@Ex.co.jp:81/a?b#c", url_netloc) == "u:p@Ex.co.jp:81"
    assert one(spark, "/Files/Report.PDF?x=1", is_file_link) is True
    assert one(spark, "/report.pdf/page", is_file_link) is False


def test_links_of_a_page(spark):
    page = (
        '<nav><a class="m" href="/about/">  <b>会社</b>概要</a></nav><a>no address</a><a href="">empty</a>'
        "<a href='doc.PDF'>file</a><a data-href='/no' href=news/1.html>News <i>1</i></a>"
        "<script>'<a href=\"/js\">js</a>'</script><a href='https://other.jp/ir'><img src=x></a>"
    )
    rows = spark.createDataFrame([(1, "https://a.jp/x/top.html", page)], "page_id long, url string, html string")
    links = pages.page_links(rows)
    got = [(r.target, r.link_text) for r in links.orderBy("link_no").collect()]
    assert got == [
        ("https://a.jp/about/", ""),
        ("https://a.jp/x/news/1.html", "news"),
        ("https://other.jp/ir", ""),
    ]
    near = pages.same_domain(links.withColumn("allowed_domain", F.lit("a.jp")))
    assert near.count() == 2
    assert pages.same_domain(links.withColumn("allowed_domain", F.lit(""))).count() == 3
    found = {r.target: r.category for r in pages.categorise_links(links).collect()}
    assert found == {
        "https://a.jp/about/": "about",
        "https://a.jp/x/news/1.html": "news",
        "https://other.jp/ir": "ir",
    }


CASES = [
    ("https://x.jp/company/ir", "", "about"),
    ("https://x.jp/p", "トップ", "about"),
    ("https://x.jp/service", "採用", "business"),
    ("https://x.jp/csr", "投資家", "sustainability"),
    ("https://firm.jp/p", "", "ir"),
    ("https://x.jp/Career", "", "recruit"),
    ("https://x.jp/p", "沿革", "history"),
    ("https://x.jp/topics", "", "news"),
    ("https://x.jp/p", "その他", None),
]


def test_category_cascade(spark):
    rows = spark.createDataFrame([c[:2] for c in CASES], "u string, t string")
    got = [r.c for r in rows.select(link_category(F.col("u"), F.col("t")).alias("c")).collect()]
    assert got == [c[2] for c in CASES]


def test_revenue_classes_and_ranges(spark):
    rows = spark.createDataFrame([(2_000_000.0,), (1_999_999.9,), (800_000.0,), (500_000.0,), (499_999.99,)], "r double")
    got = [r.c for r in rows.select(revenue_class(F.col("r")).alias("c")).collect()]
    assert got == ["S", "A", "A", "B", "C"]
    assert one(spark, "D", range_label) == "スタートアップ企業"
    assert one(spark, "X", range_label) == "不明"


def test_startup_pages(spark):
    listing = '<a href="/startups/b.html">b</a><a href="/x.html">x</a><a href="/startups/a.html">a</a><a href="/startups/b.html">b</a>'
    rows = spark.createDataFrame([(1, "u", listing)], "page_id long, url string, html string")
    got = [r.detail_url for r in pages.startup_links(rows, "https://j.jp", limit=5).collect()]
    assert got == ["https://j.jp/startups/b.html", "https://j.jp/startups/a.html"]
    detail = '<title>Acme｜J-Startup</title><div class="x">n</div><div class="a btm-arrow-blank"><p><a href="https://acme.jp">s</a></p></div>'
    missing = "<title>None｜J-Startup</title><a href='/y'>y</a>"
    rows = spark.createDataFrame([(1, detail), (2, missing)], "page_id long, html string")
    got = [tuple(r) for r in pages.startup_details(rows).select("company_name", "url", "revenue_class").collect()]
    assert got == [("Acme", "https://acme.jp", "D")]


def test_page_text_runs_once(spark, tmp_path):
    """The length filter must not evaluate the text a second time."""
    path = str(tmp_path / "pages")
    spark.createDataFrame([(1, "u", "<p>x</p>")], "page_id long, url string, html string").write.parquet(path)
    plan = pages.page_texts(spark.read.parquet(path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("<(?:!--") == 1
