"""Queries against their SQL on tables that the driver's small ones don't resemble."""

import duckdb
import pytest
from conftest import plain
from pyspark.sql import functions as F

from brindle.operators import frontier, products
from brindle.plans import queries as plans
from brindle.plans import service
from brindle.sources import fetch
from brindle.sources.store import SCHEMAS


@pytest.fixture
def held(spark, tmp_path):
    """Writes tables (name to DataFrame) to a folder and compares a query's rows there with its SQL's; how many there are."""

    def check(name, **tables):
        con = duckdb.connect()
        con.execute("SET timezone = 'UTC'")
        for t, rows in tables.items():
            rows.write.parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        cur = con.execute(plans.oracle_sql()[name])
        names = [c[0] for c in cur.description]
        want = sorted((tuple(map(plain, r)) for r in cur.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in names) for r in plans.queries()[name](spark, str(tmp_path)).collect()), key=repr)
        assert got == want
        return len(got)

    return check


def most_joined(plan) -> int:
    """The most rows that a join of an executed plan made."""
    found, open_ = 0, [plan.executedPlan()]
    while open_:
        node = open_.pop()
        kind = node.nodeName()
        if "Join" in kind and node.metrics().contains("numOutputRows"):
            found = max(found, node.metrics().get("numOutputRows").get().value())
        if kind == "AdaptiveSparkPlan":
            open_.append(node.executedPlan())
        elif "QueryStage" in kind:
            open_.append(node.plan())
        else:
            children = node.children()
            open_ += [children.apply(k) for k in range(children.size())]
    return found


def test_pages_that_share_a_url_are_requests_of_their_own(spark, held):
    rows = [(i, f"https://a.example/{i % 3}", f"<p>{i}</p>") for i in range(12)] + [(12, None, "x"), (13, None, "y"), (14, "https://a.example/0", None)]
    assert held("fetch_replay", pages=spark.createDataFrame(rows, "page_id long, url string, html string")) == 15


def test_replay_gives_one_row_for_each_request(spark):
    urls = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "url string")
    pages = spark.createDataFrame([("a", "y"), ("a", "x"), (None, "z")], "url string, html string")
    got = sorted(((r["url"], r["status"], r["body"]) for r in fetch.replay(urls, pages).collect()), key=str)
    assert got == [("a", 200, "x"), ("a", 200, "x"), ("b", 404, None), (None, 404, None)]


def test_a_round_queues_every_page_of_a_host(spark, held):
    """More URLs of one host than the frontier's cap, which is an option of the crawler."""
    i = "CAST(id AS STRING)"
    html = f"concat('<html><head><title>t', {i}, '</title></head><body><p>', repeat(concat('word', {i}, ' '), 20), '</p><a href=\"/l', {i}, '\">l</a></body></html>')"
    rows = spark.range(frontier.MOST_URLS + 50).selectExpr("id AS page_id", f"concat('https://hot.example/', {i}) AS url", f"{html} AS html")
    assert held("crawl_round", pages=rows) > frontier.MOST_URLS + 50


def test_the_cap_of_a_domain_is_an_option(spark):
    none = spark.createDataFrame([], "url_hash string, host string")
    urls = spark.createDataFrame([(f"https://a.example/{i}", 0, 0) for i in range(9)], "url string, depth int, priority int")
    assert [frontier.enqueue(urls, none.select("url_hash"), none, most_urls=n).count() for n in (4, None)] == [4, 9]


def test_a_shop_with_more_pages_than_the_cap(spark, held):
    rows = spark.range(frontier.MOST_URLS + 50).selectExpr("id AS s_suppkey")
    assert held("crawl_prices", supplier=rows) > 3 * (frontier.MOST_URLS + 50)


def test_names_that_share_their_first_letters_pair_nothing(spark):
    """item7 meets item7, item70 and so on, not every item; a product two of whose words begin alike is met once."""
    rows = [(i, f"item{i} itemised kind{i}") for i in range(2000)]
    frame = spark.createDataFrame(rows, "id long, name_normalized string")
    got = products.candidates(frame, frame)
    plan = got._jdf.queryExecution()
    want = {(a, j): sum(w.startswith(p) for p in a.split() for w in b.split()) for i, a in rows for j, b in [r for r in rows if str(r[0]).startswith(str(i))][:20]}
    assert {(r["name_normalized"], r["id"]): r["relevance"] for r in got.collect()} == want
    assert most_joined(plan) < 40_000


def test_a_call_of_the_api_fills_only_the_tables_that_it_reads(spark, sf, same, monkeypatch):
    monkeypatch.setattr(service, "_STORES", {})
    assert same(plans.queries()["api_products"](spark, sf), plans.oracle_sql()["api_products"])
    (engine,) = service._STORES.values()
    assert {t for t in SCHEMAS if engine.store.batches(t)} == {"products", "prices", "product_postings", "product_postings_size"}
    assert same(plans.queries()["api_prices"](spark, sf), plans.oracle_sql()["api_prices"]) >= 0
    assert engine.store.batches("prices") == [1]
