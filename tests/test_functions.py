"""Hand-made vectors for the column functions."""

import pytest
from pyspark.sql import functions as F

from brindle.functions import html, price, robots, text, url
from brindle.operators import search


def one(spark, column, *values):
    schema = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], schema).select(column(*[F.col(f"c{i}") for i in range(len(values))])).first()[0]


@pytest.mark.parametrize(("given", "want"), [("كتاب ي", "کتاب ی"), ("۱۲۳٤", "1234"), ("می‌روم", "می روم")])
def test_norm_persian(spark, given, want):
    assert one(spark, text.norm_persian, given) == want == text.norm_persian_text(given)


def test_norm_persian_whole(spark, sf):
    """Whole documents with probes at both ends, against a map written out here."""
    pairs = {"ي": "ی", "ك": "ک", "ة": "ه", "ۀ": "ه", "\u200c": " "} | {chr(first + i): str(i) for first in (0x660, 0x6F0) for i in range(10)}
    probe = "".join(pairs)
    rows = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(F.concat(F.lit(probe), "text", F.lit(probe)).alias("t"))
    got = rows.select("t", text.norm_persian(F.col("t")).alias("norm")).collect()
    assert max(len(r["t"]) for r in got) > 1000 and all(r["norm"] == "".join(pairs.get(c, c) for c in r["t"]) for r in got)


@pytest.mark.parametrize(("given", "want"), [("foo bar", "+foo* +bar*"), ('cheap "red bolt"', '+"red bolt" +cheap*'), ("-foo +bar", "+foo* +bar*"), ("  ", ""), ('"', "")])
def test_prepare_query(given, want):
    assert text.prepare_query(given) == want


@pytest.mark.parametrize(
    ("given", "want"),
    [("HTTP://EX.com:80/A/?utm_source=x&b=2&a=1#f", "http://ex.com:80/A?a=1&b=2"), ("https://x.com", "https://x.com/"), ("http://x.com/a//", "http://x.com/a"), ("http://x.com/a b?q=c d", "http://x.com/a%20b?q=c+d"), ("/rel", "/rel"), ("http://x.com/%zz", "http://x.com/%25zz")],
)
def test_normalize(spark, given, want):
    assert one(spark, url.normalize, given) == want
    assert one(spark, lambda c: url.normalize(url.normalize(c)), given) == want or "%25" in want


@pytest.mark.parametrize(("given", "want"), [("/page/5", False), ("/page/6", True), ("/page/2?page=9", False), ("?page=6", True), ("/2026/01/01", True), ("/2026/1", False), ("?SID=1", True)])
def test_trap(spark, given, want):
    assert one(spark, url.is_trap, "http://x.com" + given) is want


@pytest.mark.parametrize(("given", "want"), [("http://x.com/a.pdf", False), ("http://x.com/?a=1&b=2&c=3&d=4", False), ("ftp://x.com/", False), ("https://x.com/", True)])
def test_should_crawl(spark, given, want):
    assert one(spark, url.should_crawl, given) is want


def test_resolve(spark):
    assert one(spark, url.resolve, "../c", "http://x.com/a/b") == "http://x.com/c"
    assert one(spark, url.resolve, "//y.com/z", "https://x.com/") == "https://y.com/z"
    assert one(spark, url.resolve, "c", "nowhere") is None


def test_priority_boost(spark):
    boost = lambda u, d: spark.createDataFrame([(u, d)], "u string, d int").select(url.priority_boost(F.col("u"), F.col("d"))).first()[0]
    assert boost("http://x.com/product/1", 0) == 17
    assert boost("http://x.com/" + "a" * 117, 7) == 0


def test_robots():
    groups = robots.parse("User-agent: a\nUser-agent: *\nDisallow: /a # x\nAllow: /a/b\nCrawl-delay: 0.5\nUser-agent: other\nDisallow:\n")
    own = robots.select(groups, "examplebot")
    assert own.disallow == ("/a",) and own.allow == ("/a/b",) and robots.delay_ms(own) == 500
    assert robots.select([], "examplebot") is None


def test_robots_match(spark):
    urls = spark.createDataFrame([("h", p) for p in ("/a/x", "/a/b/c", "/p", "/x.php", "/x.php5", "/q")], "host string, path string")
    rules = spark.createDataFrame([("h", "disallow", "/a"), ("h", "allow", "/a/b"), ("h", "disallow", "/p"), ("h", "allow", "/p"), ("h", "disallow", "/*.php$")], "host string, kind string, pattern string")
    got = {r["path"]: r["allowed"] for r in robots.allowed(urls, rules).collect()}
    assert got == {"/a/x": False, "/a/b/c": True, "/p": False, "/x.php": False, "/x.php5": True, "/q": True}


def test_html():
    page = html.parse_page("<html lang='EN-us'><title> T </title><meta name=Description content='d'><body><p>a</p><p>b</p><script>x</script><a href='/x'>1</a><a href='#t'>n</a></body>")
    assert (page["title"], page["meta_description"], page["language"]) == ("T", "d", "en")
    assert page["content_text"].startswith("a\nb") and page["links"] == [{"href": "/x", "anchor_text": "1"}]
    assert html.parse_page("<body>سلام</body>")["language"] == "fa" and html.parse_page("<body>12</body>")["language"] is None and html.parse_page(None)["content_text"] == ""


def test_structured_prices():
    ld = '<script type="application/ld+json">{"@graph":[{"@type":["Product"],"name":"n","offers":[{"price":"1200","priceCurrency":"IRT","availability":"http://schema.org/InStock"}]}]}</script>'
    assert html.parse_page(ld)["prices"][0] | {"image_url": None} == {"product_name": "n", "price": 12000, "currency": "toman", "availability": "in_stock", "image_url": None, "confidence": 0.95}
    assert html.parse_page('<meta property="og:price:amount" content="1,500">')["prices"][0]["price"] == 1500
    assert html.parse_page('<span itemprop="price" content="77">x</span>')["prices"][0]["confidence"] == 0.92
    assert html.parse_page('<div class="product-name">n</div><b class="price">۱۲۳ تومان</b>', "torob.com")["prices"] == [{"product_name": "n", "price": 1230, "currency": "toman", "availability": "unknown", "image_url": None, "confidence": 0.75}]


@pytest.mark.parametrize(("given", "want"), [("۲۵ میلیون تومان", 250_000_000), ("۲۵۰۰ تومان", None)])
def test_price_text(spark, given, want):
    assert one(spark, lambda c: price.best(F.array(price.from_text(c)))["price"], given) == want


def test_format_toman(spark):
    assert spark.range(1).select(price.format_toman(F.lit(1234567))).first()[0] == "۱,۲۳۴,۵۶۷ تومان"


@pytest.mark.parametrize(("content", "words", "want"), [("hello world", ["world"], "hello <mark>world</mark>"), ("<b>x</b>", ["x"], "&lt;b&gt;<mark>x</mark>&lt;/b&gt;"), ("a" * 300, ["zzz"], "a" * 200 + "…"), (" ", ["x"], "")])
def test_snippet(spark, content, words, want):
    assert one(spark, lambda c: text.snippet(c, words), content) == want


@pytest.mark.parametrize(("a", "b", "want"), [("red bolt", "small red bolt", 1.0), ("a b c d e", "a b c d f", 0.8), ("0", "0", 0.0)])
def test_overlap(spark, a, b, want):
    assert one(spark, text.token_overlap, a, b) == want


def test_pages():
    assert [search.last_page(n) for n in (0, 15, 1000)] == [1, 2, 20] and search.pager(1, 3) == [1, 2, 3]
    with pytest.raises(ValueError):
        search.validate("x" * 501)


def test_soft_404(spark):
    assert one(spark, text.soft_404, "Page Not Found", "") is True and one(spark, text.soft_404, "Home", "fine") is False
