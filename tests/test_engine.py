"""The crawler's commands and the engine over a store, with a web of a few pages."""

import datetime as dt
import io
import uuid

import pytest
from pyspark.sql import functions as F

from brindle.crawler import SEED_OTHERS, SEED_SHOPS, Crawler
from brindle.engine import Cache, Engine
from brindle.functions import robots as R
from brindle.functions import text as T
from brindle.operators import search as S
from brindle.sources import store as store_module
from brindle.sources.store import Store

NOW = dt.datetime(2024, 1, 5, 12)
BODY = "a page about red bolts and blue nuts that has enough words to be indexed by the engine, and then some more "


def web():
    """Opens requests from a few pages; made where it is used, as tasks pickle it."""
    page = lambda title, more, links="": f"<html lang='en'><head><title>{title}</title></head><body><p>{BODY}{more}</p>{links}</body></html>"
    ld = '<script type="application/ld+json">{"@type":"Product","name":"Red Bolt","offers":{"price":"1200","priceCurrency":"IRT"}}</script>'
    pages = {
        "https://a.example/": page("Home", "home", "<a href='/one'>One</a><a href='/secret/x'>S</a><a href='/gone'>G</a><a href='https://b.example/z'>B</a><a href='/copy'>C</a>"),
        "https://a.example/one": page("One", "unique words of page one"),
        "https://a.example/copy": page("One", "unique words of page one"),
        "https://a.example/robots.txt": "User-agent: *\nDisallow: /secret\nCrawl-delay: 0.5",
        "https://torob.com/p/1": page("Bolt", "shop", "<b>x</b>" + ld),
    }

    def get(request, timeout):
        url = request.full_url
        if url not in pages:
            raise OSError("no such page")

        class Reply(io.BytesIO):
            status = 200
            headers = {"Content-Type": "text/plain" if url.endswith(".txt") else "text/html"}

        return Reply(pages[url].encode())

    return get


@pytest.fixture(scope="module")
def crawled(spark):
    store = Store(spark, spark.conf.get("spark.checkpoint.dir") + "/store-" + uuid.uuid4().hex)
    engine = Engine(store, clock=lambda: NOW)
    crawler = Crawler(store, get=web(), clock=lambda: NOW, delay_ms=0, partitions=2, changed=engine.changed)
    assert crawler.add(["https://a.example/", "https://torob.com/p/1"]) == 2
    assert crawler.run(2, batch=2) == 2 and crawler.run(20, batch=10) > 3
    engine.build_index()
    return store, crawler, engine


def test_crawl(crawled):
    store, crawler, _ = crawled
    urls = {r["url"] for r in store.read("pages").collect()}
    assert "https://a.example/" in urls and "https://torob.com/p/1" in urls and len(urls & {"https://a.example/one", "https://a.example/copy"}) == 1
    assert not any("secret" in u for u in urls)
    queue = {r["url"]: r for r in store.read("queue").collect()}
    assert queue["https://a.example/secret/x"]["status"] == "failed" and queue["https://a.example/gone"]["attempts"] >= 1
    own = {r["name"]: r for r in store.read("domains").collect()}
    assert own["a.example"]["crawl_delay_ms"] == 500 and "b.example" in own
    assert {r["error_message"] for r in store.read("crawl_logs").collect()} >= {"duplicate content", "failed: robots", None}
    price = store.read("prices").first()
    assert price["price"] == 12000 and store.read("price_history").count() == 1 and store.read("products").first()["name"] == "Red Bolt"
    status = crawler.status().first()
    assert status["pages"] == 3 and status["raw_waiting"] == 0
    look = crawler.monitor((0, NOW - dt.timedelta(minutes=3)), target=33)
    assert look["per_minute"] == 1.0 and look["left"] == "0h 30m" and look["megabytes"] > 0


def test_search(crawled):
    store, _, engine = crawled
    out = engine.search("unique")
    assert out["total"] == 1 and out["results"][0]["title"] == "One" and out["pager"] == [1]
    assert engine.search("bolt")["products"][0]["lowest_price"] == 12000
    assert [r["query"] for r in engine.suggest("uni").collect()] == ["unique"]
    assert [d["name"] for d in engine.domains()] == ["a.example", "torob.com"]
    assert engine.prices(store.read("products").first()["id"]).count() == 1
    board = engine.dashboard()
    assert board["products_per_domain"] == [{"name": "torob.com", "products": 1}]
    assert board["pages"] == 3 and board["searches_today"] >= 2 and board["success_rate"] == 0.3333
    assert engine.list_products().first()["prices_count"] == 1 and engine.recent_searches().count() >= 2
    for bad in ({"q": ""}, {"q": "x", "sort": "price"}, {"q": "x", "since": "yesterday"}, {"q": "x", "page": 0}):
        with pytest.raises(ValueError):
            engine.search(**bad)


def test_domains_and_schedule(crawled):
    store, crawler, engine = crawled
    engine.edit_domain("a.example", max_depth=3)
    assert store.read("domains").where("name = 'a.example'").first()["max_depth"] == 3
    engine.recrawl_domain("a.example")
    assert store.read("queue").where("priority = 20").first()["url"] == "https://a.example"
    assert crawler.pause_failing() == 0
    assert crawler.cleanup(dry_run=True).count() == 8 and crawler.cleanup().count() == 8
    later = Crawler(store, get=web(), clock=lambda: NOW + dt.timedelta(days=40))
    later.daily()
    assert store.read("search_logs").count() == 0 and len(store.batches("pages")) == 1
    assert store.read("queue").where("priority = 15").first()["url"] == "https://torob.com/p/1"
    engine.delete_domain("a.example")
    assert {r["domain"] for r in store.read("pages").collect()} == {"torob.com"} and store.read("links").count() == 0


def test_store(spark):
    store = Store(spark, spark.conf.get("spark.checkpoint.dir") + "/store-" + uuid.uuid4().hex)
    assert store.read("domains").count() == 0 and store.megabytes() == 0
    frame = lambda *rows: spark.createDataFrame(rows, "name string, max_depth int")
    store.add("domains", frame(("a", 1), ("b", 1)))
    store.add("domains", frame(("a", 2)))
    store.delete("domains", frame(("b", 0)))
    half = frame(("c", 3)).withColumns({"batch": F.lit(4), "deleted": F.lit(False)}).drop("batch")
    half.write.parquet(f"{store.root}/domains/batch=4")  # a writer that died before its marker
    rows = lambda: {(r["name"], r["max_depth"]) for r in store.read("domains").collect()}
    assert rows() == {("a", 2)}
    store.compact("domains")
    assert rows() == {("a", 2)} and store.batches("domains") == [5]


def test_cache():
    at, made = [0.0], []
    cache = Cache(lambda: at[0])
    ask = lambda: cache.get("t", 1, 10, lambda: made.append(1) or len(made))
    assert ask() == 1 and ask() == 1
    at[0] = 11
    assert ask() == 2
    cache.drop("t")
    assert ask() == 3


def test_seeds():
    assert len(SEED_SHOPS) == 12 and len(SEED_OTHERS) == 20


def test_robots_rules(spark):
    files = spark.createDataFrame([("a", "User-agent: x\nUser-agent: searchengine\nDisallow: /p # no\nDisallow:\nCrawl-delay: 1\nCrawl-delay: 0.25\n\nUser-agent: *\nDisallow: /"), ("b", None), ("c", "nothing")], "host string, body string")
    got = {tuple(r) for r in R.rules(files, "searchenginebot").collect()}
    assert got == {("a", "disallow", "/p", None), ("a", "delay", None, 250)}


def test_query_columns(spark):
    texts = ["foo bar", 'cheap "red bolt"', "-foo +bar", "", '"', '" " x', '"a  b" c* (d) @ c', 'un"closed one', 'x "y" "z w" x']
    rows = spark.createDataFrame([(t,) for t in texts], "q string").select("q", T.prepare_query_column(F.col("q")).alias("p"), T.keywords_column(F.col("q")).alias("k")).collect()
    for r in rows:
        assert r["p"] == T.prepare_query(r["q"]) and r["k"] == T.keywords(r["q"])


def test_pager():
    assert S.pager(1, 1) == [1] and S.pager(5, 20) == [3, 4, 5, 6, 7] and S.pager(20, 20) == [18, 19, 20]


@pytest.mark.parametrize("large", [0, store_module.LARGE])
def test_later_batches_lie_over_earlier_ones(spark, monkeypatch, large):
    monkeypatch.setattr(store_module, "LARGE", large)
    store = Store(spark, spark.conf.get("spark.checkpoint.dir") + "/store-" + uuid.uuid4().hex)
    frame = lambda *rows: spark.createDataFrame(rows, "name string, status string, max_depth int")
    rows = lambda: {(r["name"], r["status"], r["max_depth"]) for r in store.read("domains").collect()}
    store.add("domains", frame(("a", "x", 1), ("b", "x", 1), ("c", "y", 1), ("d", None, 1)))
    store.add("domains", frame(("a", "y", 2), ("b", "z", 2)))
    store.delete_where("domains", "status", ["x", "z"])
    assert rows() == {("a", "y", 2), ("c", "y", 1), ("d", None, 1)}  # b's row of the first batch doesn't come back
    store.add("domains", frame(("b", "x", 3)))
    store.delete("domains", frame(("c", "", 0)))
    store.add("domains", frame(("d", "x", 4)))
    assert rows() == {("a", "y", 2), ("b", "x", 3), ("d", "x", 4)} and len(store.batches("domains")) == 6
    store.compact("domains")
    assert rows() == {("a", "y", 2), ("b", "x", 3), ("d", "x", 4)} and len(store.batches("domains")) == 1
    store.delete_where("domains", "name", ["a"])
    store.delete_where("domains", "name", ["b"])
    assert rows() == {("d", "x", 4)}
    store.add("crawl_logs", spark.createDataFrame([("u", "a"), ("v", "b"), ("v", "b"), ("w", None)], "url string, domain string"))
    store.delete_where("crawl_logs", "domain", ["a"])
    store.add("crawl_logs", spark.createDataFrame([("u", "a")], "url string, domain string"))
    assert sorted(r["url"] for r in store.read("crawl_logs").collect()) == ["u", "v", "v", "w"]


def test_a_table_of_one_batch_is_read_without_a_shuffle(spark):
    store = Store(spark, spark.conf.get("spark.checkpoint.dir") + "/store-" + uuid.uuid4().hex)
    store.add("prices", spark.range(9).selectExpr("id AS product_id", "'h' AS url_hash", "concat('src', id % 3) AS domain", "id AS price"))
    plan = lambda: store.read("prices").select("domain")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan()
    store.delete_where("prices", "domain", ["src0"])
    assert "Exchange" not in plan() and store.read("prices").count() == 6


def test_a_deleted_domain_writes_no_table_again(spark):
    store = Store(spark, spark.conf.get("spark.checkpoint.dir") + "/store-" + uuid.uuid4().hex)
    store.add("domains", spark.createDataFrame([("a.example",), ("www.b.example",)], "name string"))
    store.add("queue", spark.createDataFrame([(str(k), h) for k, h in enumerate(("a.example", "www.a.example", "x.a.example", "www.b.example", "www.www.b.example"))], "url_hash string, host string"))
    store.add("crawl_logs", spark.createDataFrame([("u", "a.example")] * 500 + [("v", None), ("w", "b.example")], "url string, domain string"))
    store.add("prices", spark.range(2000).selectExpr("id AS product_id", "sha2(string(id), 256) AS url_hash", "'a.example' AS domain"))
    engine, size = Engine(store, clock=lambda: NOW), store.megabytes()
    engine.delete_domain("a.example")
    assert store.read("prices").count() == 0 and sorted(r["url"] for r in store.read("crawl_logs").collect()) == ["v", "w"]
    assert {r["host"] for r in store.read("queue").collect()} == {"x.a.example", "www.b.example", "www.www.b.example"}
    assert store.batches("crawl_logs") == [1, 2] and store.megabytes() - size < 0.02
    engine.delete_domain("www.b.example")
    assert {r["host"] for r in store.read("queue").collect()} == {"x.a.example", "www.b.example"}
