"""Operators whose cases the driver's tables don't have."""

import random

from pyspark.sql import functions as F

from brindle.operators import admin, frontier, ingest, products, search
from brindle.sources import fetch


def test_claim_caps_domains(spark):
    rows = [(i, d, 10 - i, "pending", None) for i, d in enumerate("AAABC")]
    queue = spark.createDataFrame(rows, "id long, domain_id string, priority int, status string, last_attempt_at timestamp_ntz")
    now = F.lit("2024-01-01").cast("timestamp_ntz")
    assert [r["domain_id"] for r in frontier.claim(queue, now, 3).orderBy("place").collect()] == ["A", "A", "B"]


def test_autopause(spark):
    logs = [(d * 100 + i, d, "x" if i < bad else None) for d, n, bad in ((1, 20, 11), (2, 20, 10), (3, 19, 19)) for i in range(n)]
    assert [r["domain_id"] for r in frontier.to_pause(spark.createDataFrame(logs, "id long, domain_id long, error_message string")).collect()] == [1]


def test_product_limit_comes_before_the_sort(spark):
    rows = spark.createDataFrame([(i, "bolt " * (30 - i) + "x", "bolt") for i in range(25)] + [(99, "nut", "nut")], "id long, name string, name_normalized string")
    prices = spark.createDataFrame([(i, 1, 1000 - i) for i in range(25)], "product_id long, domain_id long, price long")
    got = [r["id"] for r in search.search_products(rows, search.index(rows, "name"), prices, "bolt").collect()]
    assert len(got) == 20 and 24 not in got and got[0] == 19


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, t int, v string")
    new = spark.createDataFrame([("a", 2, "z"), ("b", 4, "w"), ("c", 1, "n"), ("c", 1, "m")], "k string, t int, v string")
    assert {r["k"]: r["v"] for r in ingest.upsert(old, new, ["k"], ["t"]).collect()} == {"a": "z", "b": "y", "c": "n"}
    assert sorted(r["v"] for r in ingest.insert_ignore(old, new, "k").collect()) == ["m", "x", "y"]


def test_match_or_create(spark):
    catalogue = spark.createDataFrame([(1, "red bolt")], "id long, name_normalized string")
    names = spark.createDataFrame([(7, "Red Bolt!"), (8, "blue nut"), (9, "blue nut"), (10, "Blue")], "name_id long, name string")
    got = {r["name_id"]: r["product_id"] for r in products.match_or_create(names, catalogue).collect()}
    assert got[7] == 1 and got[8] == got[9] == -9 and got[10] == -9


def test_gate(spark):
    assert [r[0] for r in spark.createDataFrame([("a" * 99,), ("a" * 100,)], "t string").select(ingest.gate(F.lit("t"), F.col("t"))).collect()] == ["content too short", None]


def test_fetch(spark):
    class Reply:
        status, headers = 200, {"Content-Type": "text/html"}

        def __enter__(self):
            return self

        def __exit__(self, *_):
            pass

        def read(self, n):
            return b"<p>x</p>"

    got = fetch.fetch_one("http://x/", "bot", lambda *_a, **_k: Reply())
    assert got["status"] == 200 and got["body"] == "<p>x</p>" and fetch.fetch_one("nonsense", "bot")["error"]


def test_success_rate(spark):
    assert admin.success_rate(spark.createDataFrame([(True, 200), (False, 200), (False, 200)], "has_product boolean, http_status int")).first()[0] == 0.3333
    assert admin.success_rate(spark.createDataFrame([], "has_product boolean, http_status int")).first()[0] == 0.0


def test_claimed_rows(spark):
    rows = [(i, random.Random(i).randrange(3), 1, "pending", None, 0, None) for i in range(20)]
    queue = spark.createDataFrame(rows, "id long, domain_id long, priority int, status string, last_attempt_at timestamp_ntz, attempts int, locked_by string")
    out = frontier.mark_claimed(queue, F.lit("2024-01-01").cast("timestamp_ntz"), 2, "w").collect()
    assert sum(r["status"] == "processing" for r in out) == 2 and all(r["locked_by"] == "w" for r in out if r["status"] == "processing")


def test_match_or_create_and_names_one_by_one(spark):
    """The same as names taken in order, as long as no chain of new names is among them."""
    rng = random.Random(12)
    bases = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(5)) for _ in range(30)]
    known = [(i, b) for i, b in enumerate(bases[:10])]
    names = [(100 + k, b if k % 3 else f"{b} extra{k}") for k, b in enumerate(rng.choice(bases) for _ in range(120))]
    words = lambda s: {w for w in s.split() if w != "0"}
    table, want = list(known), {}
    for i, name in names:
        found = []
        for j, c in table:
            hits = [sum(w.startswith(p) for w in set(c.split())) for p in set(name.split())]
            if all(hits):
                found.append((-sum(hits), j if j >= 0 else 10**6 - j, j, c))  # new products come after known ones
        scored = sorted((-(len(words(name) & words(c)) / min(len(words(name)), len(words(c)))), r, j) for r, (_, _, j, c) in enumerate(sorted(found)[:20]))
        if scored and -scored[0][0] > 0.8:
            want[i] = scored[0][2]
        else:
            table.append((-1 - i, name))
            want[i] = -1 - i
    got = {r["name_id"]: r["product_id"] for r in products.match_or_create(spark.createDataFrame(names, "name_id long, name string"), spark.createDataFrame(known, "id long, name_normalized string")).collect()}
    assert got == want and min(want.values()) < 0 < max(want.values())


def test_hot_hosts_are_capped_in_parts(spark):
    rows = [(f"https://hot.example/{i}", i % 7, i % 11) for i in range(400)] + [("https://cold.example/x", 0, 0)]
    none = spark.createDataFrame([], "url_hash string, host string")
    held = spark.createDataFrame([(f"h{i}", "hot.example") for i in range(30)], "url_hash string, host string")
    frame = spark.createDataFrame(rows, "url string, depth int, priority int")
    everything = frontier.enqueue(frame, none.select("url_hash"), held).collect()
    best = sorted((r for r in everything if r["host"] == "hot.example"), key=lambda r: (-r["priority"], r["url_hash"]))[:20]
    got = frontier.enqueue(frame, none.select("url_hash"), held, most_urls=50).collect()
    assert {r["url"] for r in got} == {r["url"] for r in best} | {"https://cold.example/x"}


def test_oldest_and_collisions_with_ties_and_nulls(spark):
    import datetime as dt

    pages = spark.createDataFrame([(1, "a", dt.datetime(2024, 1, 2)), (2, "a", dt.datetime(2024, 1, 1)), (3, "a", dt.datetime(2024, 1, 1)), (4, "b", None), (5, "b", dt.datetime(2023, 1, 1)), (6, None, None), (7, None, None), (8, "c", None)], "id long, content_hash string, crawled_at timestamp")
    assert sorted(r["id"] for r in admin.keep_oldest(pages).collect()) == [1, 3, 5]
    rows = spark.createDataFrame([(1, "http://x.com/a/", "old"), (2, "http://x.com/a", "old"), (3, "http://y.com/", "old")], "id long, url string, url_hash string")
    assert {r["id"]: r["action"] for r in admin.renormalize(rows).collect()} == {1: "rewrite", 2: "delete", 3: "rewrite"}
