"""The crawler's commands over a store: add, seed, fetch, process, work, run, status, monitor, cleanup and the schedule.

Fetching and processing are two jobs that meet in raw_pages. What a job fetched or parsed is written before it is used,
so that a lost executor, or a second use of the rows, neither fetches nor parses again. One driver runs the jobs of a
store; a claim is a batch of queue rows, and rows of a driver that died are claimable again after ten minutes.
"""

from __future__ import annotations

import datetime as dt
import time
import urllib.request
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import reachable
from .functions import robots as R
from .functions import url as U
from .operators import admin as A
from .operators import frontier as FR
from .operators import ingest as I
from .operators import products as PR
from .sources import fetch
from .sources.store import Store

#: The seeds (shops, then others), our agent's name, attempts a URL, rows of a batch.
SEED_SHOPS = "https://www.digikala.com https://torob.com https://basalam.com https://www.emalls.ir https://www.mobit.ir https://www.mobile.ir https://www.technolife.ir https://www.netbarg.com https://www.zanbil.ir https://www.banimode.com https://www.snappmarket.com https://www.okala.com".split()
SEED_OTHERS = "https://virgool.io https://zoomit.ir https://digikala.com/mag https://varzesh3.com https://fa.wikipedia.org https://en.wikipedia.org https://blogfa.com https://tebyan.net https://isna.ir https://farsnews.ir https://mehrnews.com https://tabnak.ir https://khabaronline.ir https://yjc.ir https://imdb.com https://medium.com https://stackoverflow.com https://github.com https://reddit.com https://mashable.com".split()
AGENT, MOST_ATTEMPTS, BATCH = "searchenginebot", 3, 10


class Crawler:
    def __init__(self, store: Store, *, agent: str = AGENT, get: Callable = urllib.request.urlopen, clock: Callable[[], dt.datetime] | None = None, delay_ms: int = FR.DELAY_MS, partitions: int = 15, changed: Callable[[], None] = lambda: None, pages: DataFrame | None = None, most_urls: int | None = FR.MOST_URLS):
        """get opens a request, unless stored pages (url, html) are to be replayed instead; clock gives the instant that counts as now (UTC); changed is called after pages or domains
        change, so that result caches can be dropped; most_urls is the number of URLs that a domain may have in the queue,
        None where a bounded crawl (stored pages) is to reach all of them."""
        self.store, self.spark, self.agent, self.get = store, store.spark, agent, get
        self.clock = clock or (lambda: dt.datetime.now(dt.UTC).replace(tzinfo=None))
        self.delay_ms, self.partitions, self.changed, self.pages, self.most_urls = delay_ms, partitions, changed, pages, most_urls
        reachable(self.spark)

    def now(self) -> Column:
        return F.lit(self.clock()).cast("timestamp_ntz")

    # ------------------------------------------------------------------ frontier

    def enqueue(self, urls: DataFrame) -> DataFrame:
        """urls (url, depth, priority) that pass the gates become queue rows; returns those."""
        queue = self.store.read("queue").select("url_hash", "host")
        new = FR.enqueue(urls, self.store.read("pages").select("url_hash"), queue, most_urls=self.most_urls)
        return self.store.add("queue", new.withColumns({"status": F.lit("pending"), "attempts": F.lit(0), "max_attempts": F.lit(MOST_ATTEMPTS), "queued_at": self.now()}))

    def add(self, urls: list[str], priority: int = FR.ADDED) -> int:
        """Domains of these URLs, if new, and the URLs themselves at depth 0; how many URLs were queued."""
        if any(not u or len(u) > 500 for u in urls):
            raise ValueError("a URL has 1 to 500 characters")
        return self.add_all(self.spark.createDataFrame([(u,) for u in urls], "url string"), priority)

    def add_all(self, urls: DataFrame, priority: int = FR.ADDED) -> int:
        """add for a table of URLs (url)."""
        self._add_domains(urls)
        return self.enqueue(urls.select("url", F.lit(0).alias("depth"), F.lit(priority).alias("priority"))).count()

    def _add_domains(self, urls: DataFrame) -> None:
        known = self.store.read("domains").select("name", "base_url", "max_depth", "crawl_delay_ms", "status")
        self.store.add("domains", FR.add_domains(known, urls).join(known.select("name"), "name", "left_anti"))
        self.changed()

    def seed(self) -> int:
        return self.add(SEED_SHOPS, FR.SEED_SHOP) + self.add(SEED_OTHERS, FR.SEED_OTHER)

    def claim(self, batch: int = BATCH, worker: str = "worker") -> DataFrame:
        """The queue rows that the worker now holds. Only the rows looked at are written, five for each claimed at most."""
        queue = self.store.read("queue").withColumns({"id": F.concat(F.date_format("queued_at", "yyyyMMddHHmmss"), "url_hash"), "domain_id": F.col("host")})
        looked = FR.claimable(queue, self.now()).orderBy(F.col("priority").desc(), "id").limit(FR.SCAN * batch)
        marked = FR.mark_claimed(looked, self.now(), batch, worker)
        held = (F.col("status") == "processing") & F.col("locked_by").eqNullSafe(worker)
        rows = self.store.add("queue", marked.withColumn("last_attempt_at", F.when(held, self.now()).otherwise(F.col("last_attempt_at"))))
        return rows.where(held)

    # ------------------------------------------------------------------ fetching

    def _fetch(self, urls: DataFrame, **options) -> DataFrame:
        if self.pages is not None:
            return fetch.replay(urls, self.pages)
        return fetch.fetch(urls, agent=self.agent, delay_ms=self.delay_ms, partitions=self.partitions, get=self.get, **options)

    def _read_robots(self, hosts: DataFrame) -> None:
        """Robots files of domains (name) that have none yet; a failure reads as an empty file, which allows all."""
        due = self.store.read("domains").where("robots_txt is null").join(hosts, "name", "left_semi")
        own = due.select("*", F.concat("base_url", F.lit("/robots.txt")).alias("_url"))
        got = self._fetch(own.select(F.col("name").alias("host"), F.col("_url").alias("url")), types=()).select(F.col("url").alias("_url"), F.when(F.col("status") == 200, F.col("body")).alias("body"))
        found = own.join(got, "_url", "left").withColumn("robots_txt", F.coalesce("body", F.lit("")))
        rules = R.rules(found.select(F.col("name").alias("host"), "body"), self.agent).where("kind = 'delay'").select(F.col("host").alias("name"), F.col("delay_ms").cast("int").alias("_delay"))
        self.store.add("domains", found.join(rules, "name", "left").withColumn("crawl_delay_ms", F.coalesce("_delay", "crawl_delay_ms")))

    def fetch(self, batch: int = BATCH, worker: str = "fetcher") -> int:
        """Pipeline 1: claims rows, drops those that may not be fetched, fetches, and keeps raw pages. How many were claimed."""
        return self.fetch_held(self.claim(batch, worker))

    def fetch_held(self, rows: DataFrame) -> int:
        """Pipeline 1 for queue rows that are claimed already."""
        held = rows.withColumn("name", U.bare_host(F.col("url")))
        n = held.count()
        if not n:
            return 0
        self._read_robots(held.select("name").distinct())
        domains = self.store.read("domains").join(F.broadcast(held.select("name").distinct()), "name", "left_semi")
        rules = R.rules(domains.select(F.col("name").alias("host"), F.col("robots_txt").alias("body")), self.agent).where("kind <> 'delay'")
        items = R.allowed(held.select(*self.store.columns("queue"), F.col("name").alias("domain_id"), U.part(F.col("url"), 3).alias("_path")), rules.withColumnRenamed("host", "domain_id"), key="domain_id", path="_path")
        ready = FR.prepare(items, domains.select(F.col("name").alias("id"), "status"), F.col("allowed"))
        sent = ready.where("outcome = 'ready'")
        got = self._fetch(sent.select("host", "url")).dropDuplicates(["url"])
        own = ["url_hash", "url", "host", "depth", "attempts", "max_attempts"]
        refused = ready.where("outcome <> 'ready'").select(*own, F.col("outcome").alias("error"))
        rows = sent.select(*own).join(got, "url").unionByName(refused, allowMissingColumns=True)
        done = self.store.add("fetches", rows)  # nothing is fetched twice
        gone = F.coalesce(F.col("error"), F.lit("")).startswith("failed: ")
        status = F.when(gone, "failed").otherwise(FR.outcome(F.col("error"), F.col("status"), F.col("skipped_reason"), F.col("attempts"), F.col("max_attempts")))
        good = done.where("body is not null and status < 400")
        self.store.add("raw_pages", good.withColumns({"html": F.col("body"), "fetched_at": self.now(), "processed": F.lit(False), "attempts": F.lit(0)}))
        ends = done.select("url_hash", status.alias("_status"))
        self.store.add("queue", held.join(ends, "url_hash").withColumns({"status": F.col("_status"), "locked_by": F.lit(None)}))
        message = F.coalesce("error", F.concat(F.lit("Skipped: "), "skipped_reason"), F.when(F.col("status") >= 400, F.concat(F.lit("HTTP "), F.col("status").cast("string"))))
        logged = done.where(F.coalesce("error", F.lit("")) != "failed: inactive")
        copies = F.array_repeat(F.lit(0), FR.log_rows(F.col("error"), F.col("status")))
        self.store.add("crawl_logs", logged.select("url", U.bare_host(F.col("url")).alias("domain"), "status", "response_time_ms", message.alias("error_message"), self.now().alias("crawled_at"), F.explode(copies)))
        return n

    # ------------------------------------------------------------------ processing

    def process(self, batch: int = BATCH) -> int:
        """Pipeline 2: parses raw pages in order of arrival, gates them, and writes pages, links, prices and new queue rows."""
        raw = self.store.read("raw_pages").where("not processed").orderBy("fetched_at", "url_hash").limit(batch)
        fields = I.parse_raw(raw.select("url", "html")).drop("links", "url").dropDuplicates(["url_hash"])
        parsed = raw.select("url_hash", "url", "host", "depth", "html", F.col("status").alias("http_status"), "content_type").join(fields, "url_hash")
        texts = parsed.select(F.sha2(F.coalesce("content_text", F.lit("")), 256).alias("content_hash")).distinct()
        known = self.store.read("pages").select("content_hash", "url_hash").join(F.broadcast(texts), "content_hash", "left_semi")
        rows = self.store.add("parsed", I.gate_pages(parsed, known))  # nothing is parsed twice
        n = rows.count()
        if not n:
            return 0
        good = rows.where("error is null and reason is null")
        host = U.bare_host(F.col("url"))
        prices = self._prices(good)
        sold = prices.select("url_hash", F.lit(True).alias("_sold")).distinct()
        earlier = self.store.read("pages").where("has_product").select("url_hash", F.lit(True).alias("_before"))
        pages = good.join(sold, "url_hash", "left").join(earlier, "url_hash", "left")
        self.store.add("pages", pages.withColumns({"domain": host, "has_product": F.coalesce("_sold", "_before", F.lit(False)), "status": F.lit("indexed"), "crawled_at": self.now()}))
        links = I.page_links(good, id_col="url_hash").withColumnRenamed("page_id", "source_hash").withColumn("target_hash", F.sha2("target_url", 256))
        links = self.store.add("links", links)
        self._follow(links, good.select(F.col("url_hash").alias("source_hash"), "depth", host.alias("name")))
        tried = raw.join(rows.select("url_hash", "error"), "url_hash")
        failed = I.after_failure(tried.where("error is not null"))
        self.store.add("raw_pages", failed.unionByName(tried.where("error is null").withColumn("processed", F.lit(True))))
        self.store.add("crawl_logs", rows.select("url", host.alias("domain"), F.when(F.coalesce("error", "reason").isNull(), F.col("url_hash")).alias("page_hash"), F.col("http_status").alias("status"), F.coalesce("error", "reason").alias("error_message"), self.now().alias("crawled_at")))
        self.changed()
        return n

    def _follow(self, links: DataFrame, sources: DataFrame) -> None:
        """Internal links go to the queue while the domain's depth allows; external ones may be new domains."""
        if links.isEmpty():
            return
        domains = self.store.read("domains")
        deep = sources.join(domains.select("name", "max_depth"), "name", "left")
        inner = links.where("not is_external").join(F.broadcast(deep), "source_hash").where(F.col("depth") < F.coalesce("max_depth", F.lit(FR.DEPTH)))
        self.enqueue(inner.select(F.col("target_url").alias("url"), (F.col("depth") + 1).alias("depth"), F.lit(0).alias("priority")))
        outer = links.where("is_external").select(F.col("source_hash").alias("page_id"), F.col("target_hash").alias("pos"), "target_url", "is_external")
        new = self.spark.createDataFrame([tuple(r) for r in FR.discover(outer, domains).collect()], "name string, base_url string, priority int")  # 5,000 rows at most
        self._add_domains(new.select(F.col("base_url").alias("url")))
        self.enqueue(new.select(F.col("base_url").alias("url"), F.lit(0).alias("depth"), "priority"))

    def _prices(self, good: DataFrame) -> DataFrame:
        """Prices of shop pages: the product that the name matches, or a new one; every sighting goes to the history."""
        found = I.product_prices(good).join(good.select("url", "url_hash", "title"), "url").withColumn("name", F.coalesce("product_name", "title")).where("name is not null")
        # Written before it is matched: the plans of the match use it many times over.
        found = self.store.add("offers", found.withColumn("name_id", F.pmod(F.xxhash64("url_hash"), F.lit(2**62))))
        if found.isEmpty():
            return self.store.none("prices")
        catalogue = self.store.read("products").groupBy("name_normalized").agg(F.min("id").alias("id"))
        matched = PR.match_or_create(found.select("name_id", "name"), catalogue)
        rows = found.join(matched, "name_id").withColumns({"domain": U.bare_host(F.col("url")), "product_url": F.col("url"), "extracted_at": self.now()})
        rows = self.store.add("sightings", rows)  # nothing is matched twice
        new = rows.groupBy(F.col("product_id").alias("id")).agg(F.min(F.struct("name", "name_normalized", "image_url")).alias("x")).select("id", "x.*")
        self.store.add("products", new.join(self.store.read("products").select("id"), "id", "left_anti"))
        self.store.add("price_history", rows.withColumn("recorded_at", F.col("extracted_at")))
        return self.store.add("prices", rows)

    def work(self, batch: int = BATCH, worker: str = "worker") -> int:
        """Both pipelines, one after the other; how many rows were claimed."""
        n = self.fetch(batch, worker)
        self.process(max(batch, n))
        return n

    def run(self, items: int, batch: int = BATCH, worker: str = "worker") -> int:
        """Works until so many items are done or nothing is claimable."""
        done = 0
        while done < items and (n := self.work(min(batch, items - done), worker)):
            done += n
        return done

    def start(self, *, batch: int = BATCH, seconds: float = 300, idle: float = 5, stop: Callable[[], bool] = lambda: False) -> int:
        """Works for so long, or until told to stop; waits while nothing is claimable. See jobs for supervision and the
        schedule; a larger batch stands for more workers."""
        end, done = time.monotonic() + seconds, 0
        while time.monotonic() < end and not stop():
            n = self.work(batch)
            done += n
            if not n:
                time.sleep(min(idle, max(0.0, end - time.monotonic())))
        return done

    # ------------------------------------------------------------------ watching and keeping in order

    def status(self) -> DataFrame:
        """One row: pages, domains, the queue by status, raw pages that wait."""
        s = self.store
        waiting = s.read("raw_pages").agg(F.count_if(~F.col("processed")).alias("raw_waiting"))
        counts = A.status_counts(s.read("queue"), ["pending", "processing", "done", "failed"])
        return s.read("pages").agg(F.count("*").alias("pages")).join(s.read("domains").agg(F.count("*").alias("domains"))).join(counts).join(waiting)  # one row each

    def monitor(self, before: tuple[int, dt.datetime] | None = None, target: int = 1_000_000) -> dict:
        """Pages, pages a minute since an earlier look (pages, instant), time left to the target, and size on disk."""
        pages, at = self.store.read("pages").count(), self.clock()
        minutes = (at - before[1]).total_seconds() / 60 if before else 0
        rate = (pages - before[0]) / minutes if minutes > 0 else 0.0
        return {"pages": pages, "at": at, "per_minute": rate, "left": A.duration(max(0, target - pages) / rate) if rate > 0 else None, "megabytes": round(self.store.megabytes(), 2)}

    def pause_failing(self) -> int:
        """Pauses domains most of whose last 20 logs are errors; how many."""
        logs = self.store.read("crawl_logs").select(F.col("domain").alias("domain_id"), "error_message", F.concat(F.date_format("crawled_at", "yyyyMMddHHmmss"), F.sha2(F.concat_ws("|", "url", "error_message"), 256)).alias("id"))
        bad = FR.to_pause(logs).select(F.col("domain_id").alias("name"))
        return self.store.add("domains", self.store.read("domains").where("status = 'active'").join(bad, "name", "left_semi").withColumn("status", F.lit("paused"))).count()

    def cleanup(self, dry_run: bool = False) -> DataFrame:
        """Counts of what the passes would do; without dry_run they are done: duplicate and junk pages go, then URLs are
        normalised again, then junk in the queue goes."""
        pages = self.store.read("pages").withColumn("id", F.col("url_hash"))
        queue = self.store.read("queue").withColumn("id", F.col("url_hash"))
        # Counted before anything changes; eight rows.
        counts = self.spark.createDataFrame([tuple(r) for r in A.cleanup_counts(pages, queue).collect()], "pass string, n long")
        if not dry_run:
            gone = A.keep_oldest(pages).select("id").unionByName(A.junk_pages(pages).select("id"))
            self.store.delete("pages", gone.withColumnRenamed("id", "url_hash"))
            for name in ("pages", "queue"):
                own = self.store.read(name)
                again = A.renormalize(own.select(F.col("url_hash").alias("id"), "url", "url_hash")).where("action <> 'keep'")
                moved = again.where("action = 'rewrite'").select("id", "new_url", "new_hash")
                self.store.add(name, own.join(moved, F.col("url_hash") == F.col("id")).withColumns({"url": F.col("new_url"), "url_hash": F.col("new_hash")}))
                self.store.delete(name, again.where("id <> new_hash").select(F.col("id").alias("url_hash")))
            self.store.delete("queue", A.junk_queue(self.store.read("queue")))
            self.changed()
        return counts

    def daily(self) -> None:
        """The daily schedule: stale claims are reset, old search logs go, product pages are due again, tables are compacted."""
        s = self.store
        queue = s.read("queue")
        held = queue.where((F.col("status") == "processing") & FR.stale(self.now(), 30))
        s.add("queue", held.withColumns({"status": F.lit("pending"), "locked_by": F.lit(None)}))
        s.replace("search_logs", A.retain(s.read("search_logs"), self.now()))
        due = FR.recrawl(s.read("pages"), s.read("queue").select("url_hash", "url", "status", "priority", "attempts"), self.now()).where((F.col("status") == "pending") & (F.col("priority") == FR.RECRAWL))
        rest = s.read("queue").select("url_hash", "depth", "max_attempts", "last_attempt_at", "queued_at")
        full = due.join(rest, "url_hash", "left").withColumns({"host": U.host(F.col("url")), "depth": F.coalesce("depth", F.lit(0)), "max_attempts": F.coalesce("max_attempts", F.lit(MOST_ATTEMPTS)), "queued_at": F.coalesce("queued_at", self.now())})
        s.add("queue", full)
        for name in ("queue", "raw_pages", "pages", "links", "domains", "products", "prices"):
            s.compact(name)
        for name in ("fetches", "parsed", "offers", "sightings"):
            s.replace(name, s.none(name))
