"""The search engine as an object over a store: what its API and its administration pages offer, as DataFrames."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operators import admin as A
from .operators import frontier as FR
from .operators import search as S
from .sources.store import Store

#: Seconds that results and the dashboard are kept; queries suggested; products listed.
KEEP_RESULTS, KEEP_DASHBOARD, SUGGESTED, LISTED = 300, 30, 5, 25
#: Search logs that are held in memory until they are written together.
KEPT_LOGS = 1000


class Cache:
    """Values with a time to live, dropped by tag; lost when the driver ends, which harms nothing."""

    def __init__(self, clock: Callable[[], float] = time.monotonic, most: int = 10_000):
        self.clock, self.most, self.kept = clock, most, {}

    def get(self, tag: str, key: Any, seconds: float, make: Callable[[], Any]) -> Any:
        full = (tag, repr(key))
        if full in self.kept and self.kept[full][0] > self.clock():
            return self.kept[full][1]
        value = make()
        if len(self.kept) >= self.most:
            self.kept.clear()
        self.kept[full] = (self.clock() + seconds, value)
        return value

    def drop(self, *tags: str) -> None:
        self.kept = {k: v for k, v in self.kept.items() if k[0] not in tags}


class Engine:
    def __init__(self, store: Store, *, clock: Callable[[], dt.datetime] | None = None, cache: Cache | None = None):
        self.store, self.cache, self.unwritten = store, cache or Cache(), []
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))

    def now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp_ntz")

    def changed(self) -> None:
        """To be called after pages or domains change."""
        self.cache.drop("search", "domains", "dashboard")

    def build_index(self, *names: str) -> None:
        """Sorted postings of all pages (postings) and of all products (product_postings), and their numbers: of those named,
        or both; searches read the last ones built."""
        products = self.store.read("products").withColumn("id", F.col("id").cast("string"))
        for name, rows, columns in (("postings", self._pages(), ("title", "content_text")), ("product_postings", products, ("name", "name_normalized"))):
            if not names or name in names:
                self.store.replace(name, S.sorted_postings(S.index(rows, *columns)))
                self.store.replace(f"{name}_size", rows.agg(F.count("*").alias("n")))
        self.changed()

    def _index(self, name: str) -> tuple[DataFrame, int]:
        size = self.store.read(f"{name}_size").first()
        return self.store.read(name), size["n"] if size else 0

    def _pages(self) -> DataFrame:
        return self.store.read("pages").withColumn("id", F.col("url_hash"))

    def _links(self) -> DataFrame:
        return self.store.read("links").select(F.col("target_hash").alias("target_page_id"))

    # ------------------------------------------------------------------ search

    def search(self, q: str, *, page: int = 1, domain: str | None = None, language: str | None = None, since: str | None = None, until: str | None = None, sort: str = "relevance", ip: str | None = None, user_agent: str | None = None) -> dict:
        """A page of results, the total, pager buttons and products of the same query. Each call is logged; results are
        kept for five minutes (ten rows, so they are plain rows)."""
        S.validate(q, page, language, domain, sort)
        for day in (since, until):
            if day is not None:
                dt.date.fromisoformat(day)
        began, filters = time.perf_counter(), {"domain": domain, "language": language, "since": since, "until": until}

        def make() -> dict:
            pages, (postings, n) = self._pages(), self._index("postings")
            found = S.totals(pages, postings, q, n_docs=n, **filters).first()
            rows = self.results(q, page=page, sort=sort, **filters).orderBy("position").collect()
            return {"results": [r.asDict() for r in rows], "total": found["total"], "page": page, "last_page": found["last_page"], "pager": S.pager(page, found["last_page"]), "products": [r.asDict(True) for r in self.search_products(q).collect()]}

        out = self.cache.get("search", (q, page, sort, filters), KEEP_RESULTS, make)
        self.log_search(q, out["total"], int((time.perf_counter() - began) * 1000), ip, user_agent)
        return out

    def results(self, q: str, *, page: int = 1, sort: str = "relevance", **filters) -> DataFrame:
        """The rows of a page of results."""
        postings, n = self._index("postings")
        return S.search(self._pages(), postings, self._links(), q, self.now(), page=page, sort=sort, n_docs=n, **filters)

    def log_search(self, q: str, results: int, ms: int, ip: str | None, user_agent: str | None) -> None:
        """Keeps the row in memory; KEPT_LOGS rows, or whoever reads the logs here, write a batch. A driver that dies
        loses the rows that it holds."""
        self.unwritten.append((q, results, ms, ip, user_agent, self.clock()))
        if len(self.unwritten) >= KEPT_LOGS:
            self.flush()

    def flush(self) -> None:
        """Writes the search logs that are held in memory, as one batch."""
        if self.unwritten:
            rows, self.unwritten = self.unwritten, []
            self.store.add("search_logs", self.store.spark.createDataFrame(rows, "query string, results_count long, response_time_ms long, ip string, user_agent string, searched_at timestamp_ntz"))

    def _search_logs(self) -> DataFrame:
        self.flush()
        return self.store.read("search_logs")

    def suggest(self, prefix: str) -> DataFrame:
        if not prefix or len(prefix) > 500:
            raise ValueError("a prefix has 1 to 500 characters")
        return S.suggest(self._search_logs(), prefix, SUGGESTED)

    def search_products(self, q: str, sort: str = "price_asc") -> DataFrame:
        S.validate(q)
        postings, n = self._index("product_postings")
        prices = self.store.read("prices").withColumn("domain_id", F.col("domain"))
        return S.search_products(self.store.read("products"), postings.withColumn("id", F.col("id").cast("long")), prices, q, n_docs=n, sort=sort)

    def prices(self, product_id: int) -> DataFrame:
        return S.prices_of(self.store.read("prices").withColumn("domain_id", F.col("domain")), None, product_id)

    def domains(self) -> list[dict]:
        """Active domains that have pages, by name; kept for five minutes."""

        def make() -> list[dict]:
            n = self.store.read("pages").groupBy(F.col("domain").alias("name")).agg(F.count("*").alias("pages_count"))
            rows = self.store.read("domains").where("status = 'active'").join(n, "name").select("name", "pages_count")
            return [r.asDict() for r in rows.orderBy("name").limit(FR.MOST_DOMAINS).collect()]  # there are no more

        return self.cache.get("domains", None, KEEP_RESULTS, make)

    # ------------------------------------------------------------------ administration

    def dashboard(self) -> dict:
        """Counts, activity a day, popular queries and products a domain, the success rate; kept for half a minute."""

        def make() -> dict:
            s, searches = self.store, self._search_logs()
            logs = s.read("crawl_logs").withColumn("page_id", F.col("page_hash"))
            counts = A.dashboard(s.read("pages"), s.read("domains"), s.read("queue"), logs, searches, self.now()).first().asDict()
            days = lambda rows, at: [r.asDict() for r in A.per_day(rows, at, self.now()).orderBy("day").collect()]
            return counts | {"pages_per_day": days(logs.where("page_id is not null"), "crawled_at"), "searches_per_day": days(searches, "searched_at"), "popular": [r.asDict() for r in A.popular(searches, self.now()).collect()], "success_rate": A.success_rate(s.read("pages")).first()[0], "products_per_domain": [r.asDict() for r in self.products_per_domain().limit(FR.MOST_DOMAINS).collect()]}

        return self.cache.get("dashboard", None, KEEP_DASHBOARD, make)

    def products_per_domain(self) -> DataFrame:
        """Domains with the number of distinct products that they sell, the most first."""
        prices = self.store.read("prices").withColumn("domain_id", F.col("domain"))
        return A.products_per_domain(prices, self.store.read("domains").withColumn("id", F.col("name"))).orderBy(F.col("products").desc(), "name")

    def recent_searches(self) -> DataFrame:
        return A.recent(self._search_logs().withColumn("id", F.sha2(F.concat_ws("|", "query", "ip", "user_agent"), 256)))

    def list_products(self, page: int = 1) -> DataFrame:
        """Products by number of prices, 25 a page."""
        n = self.store.read("prices").groupBy(F.col("product_id").alias("id")).agg(F.count("*").alias("prices_count"))
        rows = self.store.read("products").join(n, "id", "left").withColumn("prices_count", F.coalesce("prices_count", F.lit(0)))
        return A.page_of(rows, [F.col("prices_count").desc(), F.col("id")], page, LISTED)

    def list_domains(self, page: int = 1) -> DataFrame:
        """Domains with their pending and failed queue rows, 25 a page."""
        queue = self.store.read("queue").withColumn("domain_id", F.regexp_replace("host", r"^www\.", ""))
        return A.page_of(A.with_counts(self.store.read("domains").withColumn("id", F.col("name")), queue), [F.col("name")], page, LISTED)

    def edit_domain(self, name: str, **changes) -> None:
        """status, max_depth, crawl_delay_ms."""
        own = self.store.read("domains").where(F.col("name") == name)
        self.store.add("domains", A.edit_domain(own, name, **changes))
        self.changed()

    def recrawl_domain(self, name: str) -> None:
        """The domain is active again, and its start page pending with priority 20, whatever became of it before."""
        self.edit_domain(name, status="active")
        own = self.store.read("domains").where(F.col("name") == name).select(F.col("base_url").alias("url"), F.col("name").alias("host"))
        row = own.withColumns({"url_hash": F.sha2("url", 256), "depth": F.lit(0), "priority": F.lit(FR.RECRAWL_ADMIN), "status": F.lit("pending"), "attempts": F.lit(0), "max_attempts": F.lit(3), "queued_at": self.now()})
        self.store.add("queue", row)

    def delete_domain(self, name: str) -> None:
        """The domain, its pages with their links and prices, its raw pages, its queue rows and its logs go."""
        s = self.store
        hosts = [f"www.{name}"] if name.startswith("www.") else [name, f"www.{name}"]  # those whose bare host is the name
        pages = s.read("pages").where(F.col("domain") == name).select(F.col("url_hash").alias("source_hash"))
        s.delete("links", s.read("links").join(pages, "source_hash", "left_semi"))
        for table, column, values in (("prices", "domain", [name]), ("raw_pages", "host", hosts), ("queue", "host", hosts), ("crawl_logs", "domain", [name]), ("pages", "domain", [name]), ("domains", "name", [name])):
            s.delete_where(table, column, values)
        self.changed()


__all__ = ["Cache", "Engine"]
