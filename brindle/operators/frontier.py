"""The crawl frontier: enqueue, claim, retry, pause, discover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import url as U

#: Minutes until a claim is stale, rows looked at for each row claimed, rows a domain and batch, logs that
#: decide on a pause and their share of errors, URLs a domain, new domains a page and in all, priorities.
STALE_MINUTES, SCAN, PER_DOMAIN, SAMPLE, ERRORS = 10, 5, 2, 20, 0.5
MOST_URLS, NEW_DOMAINS, MOST_DOMAINS = 10_000, 5, 5_000
SEED_SHOP, SEED_OTHER, ADDED, DISCOVERED, RECRAWL, RECRAWL_ADMIN = 20, 10, 10, 0, 15, 20
DEPTH, DEPTH_SHOP, DELAY_MS = 10, 15, 200
#: Parts of a domain that are capped by themselves first.
SALTS = 64


def stale(now: Column, minutes: int) -> Column:
    return F.col("last_attempt_at") < now - F.make_dt_interval(mins=F.lit(minutes))


def claimable(queue: DataFrame, now: Column) -> DataFrame:
    return queue.where((F.col("status") == "pending") | ((F.col("status") == "processing") & stale(now, STALE_MINUTES)))


def claim(queue: DataFrame, now: Column, batch: int) -> DataFrame:
    """The rows that a batch gets, with place: by priority, then id; at most two a domain; of the first 5 x batch rows.

    The first 5 x batch come from a top-k, so both windows see a bounded number of rows."""
    order = [F.col("priority").desc(), F.col("id")]
    seen = claimable(queue, now).orderBy(*order).limit(SCAN * batch)
    kept = seen.withColumn("_n", F.row_number().over(W.partitionBy("domain_id").orderBy(*order))).where(F.col("_n") <= PER_DOMAIN)
    return kept.withColumn("place", F.row_number().over(W.orderBy(*order))).where(F.col("place") <= batch).drop("_n")


def mark_claimed(queue: DataFrame, now: Column, batch: int, worker: str) -> DataFrame:
    """The queue after a claim: every row looked at up to the last one taken has one more attempt; those taken are locked."""
    order = [F.col("priority").desc(), F.col("id")]
    seen = claimable(queue, now).orderBy(*order).limit(SCAN * batch).select("id", F.row_number().over(W.orderBy(*order)).alias("_spot"))
    taken = claim(queue, now, batch).select("id", F.lit(True).alias("_taken"))
    marks = seen.join(taken, "id", "left")
    end = marks.agg(F.max(F.when(F.col("_taken"), F.col("_spot"))).alias("_end"), F.count("_taken").alias("_n"))
    marks = marks.join(F.broadcast(end), (F.col("_spot") <= F.col("_end")) | (F.col("_n") < batch)).select("id", "_taken", F.lit(1).alias("_seen"))
    out = queue.join(F.broadcast(marks), "id", "left").withColumn("attempts", F.col("attempts") + F.coalesce("_seen", F.lit(0)))
    return out.withColumn("status", F.when(F.col("_taken"), "processing").otherwise(F.col("status"))).withColumn("locked_by", F.when(F.col("_taken"), F.lit(worker))).drop("_taken", "_seen")


def add_domains(domains: DataFrame, urls: DataFrame) -> DataFrame:
    """domains and those of urls that aren't known yet: name, base_url, max_depth, crawl_delay_ms, status."""
    urls = U.once(urls, "_u", U.normalize(F.col("url")))
    u = F.col("_u")
    new = urls.select(U.bare_host(u).alias("name"), F.concat(U.part(u, 1), F.lit("://"), U.part(u, 2)).alias("base_url"), F.when(U.is_shop(u), DEPTH_SHOP).otherwise(DEPTH).alias("max_depth"), F.lit(DELAY_MS).alias("crawl_delay_ms"), F.lit("active").alias("status")).where("name <> ''")
    one = new.groupBy("name").agg(F.min(F.struct("base_url", "max_depth", "crawl_delay_ms", "status")).alias("x")).select("name", "x.*")
    return domains.unionByName(one.join(domains.select("name"), "name", "left_anti").select(*domains.columns))


def enqueue(urls: DataFrame, pages: DataFrame, queue: DataFrame, *, iran_only: bool = False, most_urls: int | None = MOST_URLS) -> DataFrame:
    """New queue rows from urls (url, depth, priority): url, url_hash, host, depth, priority. Gates in order: worth
    crawling and no trap, country, shops' pages that are no products, known pages, known URLs, and `most_urls` a domain,
    the best by priority, then hash; None: all of them. Anti-joins on the hash. The cap is applied to SALTS parts of each domain first, so
    that a domain with a third of all rows is sorted by many tasks, and then to the SALTS x most_urls rows that may be left."""
    urls = U.once(urls, "_u", U.normalize(F.col("url")))
    u = F.col("_u")
    ok = U.should_crawl(u) & ~U.is_trap(u) & U.passes_country(u, iran_only) & ~(U.is_shop(u) & U.other_path(u))
    new = urls.where(ok).select(u.alias("url"), F.sha2(u, 256).alias("url_hash"), U.host(u).alias("host"), F.col("depth").cast("int").alias("depth"), (F.col("priority") + U.priority_boost(u, F.col("depth"))).cast("int").alias("priority"))
    new = new.groupBy("url_hash").agg(F.max(F.struct("priority", "depth", "url", "host")).alias("x")).select("url_hash", "x.*")
    new = new.join(pages.select("url_hash"), "url_hash", "left_anti").join(queue.select("url_hash"), "url_hash", "left_anti")
    if most_urls is None:
        return new.select("url", "url_hash", "host", "depth", "priority")
    held = queue.groupBy("host").agg(F.count("*").alias("_held"))
    place = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy(F.col("priority").desc(), "url_hash"))
    new = new.withColumn("_salt", F.pmod(F.xxhash64("url_hash"), F.lit(SALTS))).withColumn("_n", place("host", "_salt")).where(F.col("_n") <= most_urls)
    new = new.join(held, "host", "left").withColumn("_n", place("host") + F.coalesce("_held", F.lit(0))).where(F.col("_n") <= most_urls)
    return new.select("url", "url_hash", "host", "depth", "priority")


def prepare(items: DataFrame, domains: DataFrame, allowed: Column) -> DataFrame:
    """Queue items with outcome: inactive domain and blocked path fail at once, only the latter is logged."""
    own = domains.select(F.col("id").alias("domain_id"), F.col("status").alias("_domain"))
    met = items.join(own, "domain_id", "left")
    return met.withColumn("outcome", F.when(F.coalesce("_domain", F.lit("")) != "active", "failed: inactive").when(~allowed, "failed: robots").otherwise("ready")).drop("_domain")


def outcome(error: Column, status: Column, skipped: Column, attempts: Column, most: Column) -> Column:
    """A queue row's status after a fetch: done, or pending again while attempts are left, or failed."""
    bad = error.isNotNull() | status.isNull() | (status >= 400)
    return F.when(skipped.isNotNull(), "done").when(bad & (attempts >= most), "failed").when(bad, "pending").otherwise("done")


def log_rows(error: Column, status: Column) -> Column:
    """Log rows that a fetch leaves: a status of 400 or more is logged by the fetch and by the failure."""
    return F.when(error.isNull() & (status >= 400), 2).otherwise(1)


def error_rates(logs: DataFrame) -> DataFrame:
    """domain_id and rate: the share of rows with an error message among each domain's newest 20, if it has 20."""
    newest = logs.withColumn("_n", F.row_number().over(W.partitionBy("domain_id").orderBy(F.col("id").desc()))).where(F.col("_n") <= SAMPLE)
    return newest.groupBy("domain_id").agg(F.count("*").alias("n"), F.count("error_message").alias("errors")).where(F.col("n") == SAMPLE).select("domain_id", (F.col("errors") / SAMPLE).alias("rate"))


def to_pause(logs: DataFrame) -> DataFrame:
    return error_rates(logs).where(F.col("rate") > ERRORS)


def discover(links: DataFrame, domains: DataFrame, *, most: int = MOST_DOMAINS) -> DataFrame:
    """New domains from external links (page_id, pos, target_url): up to five a page in order, hosts not known, until
    there are `most`. name, base_url, priority."""
    known = domains.select("name")
    hosts = links.where("is_external").select("page_id", "pos", U.bare_host(F.col("target_url")).alias("name"), F.concat(U.part(F.col("target_url"), 1), F.lit("://"), U.part(F.col("target_url"), 2)).alias("base_url")).where("name <> ''")
    new = hosts.join(known, "name", "left_anti").groupBy("page_id", "name").agg(F.min("pos").alias("pos"), F.min("base_url").alias("base_url"))
    few = new.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("pos", "name"))).where(F.col("_n") <= NEW_DOMAINS)
    one = few.groupBy("name").agg(F.min(F.struct("page_id", "pos", "base_url")).alias("x"))
    room = known.agg(F.greatest(F.lit(0), most - F.count("*")).alias("_room"))
    # A bounded number comes through the top-k before it is numbered.
    first = one.orderBy("x.page_id", "x.pos", "name").limit(most).withColumn("_n", F.row_number().over(W.orderBy("x.page_id", "x.pos", "name")))
    return first.join(F.broadcast(room), F.col("_n") <= F.col("_room")).select("name", F.col("x.base_url").alias("base_url"), F.lit(DISCOVERED).alias("priority"))


def recrawl(pages: DataFrame, queue: DataFrame, now: Column) -> DataFrame:
    """The queue after the daily schedule: product pages not crawled for a day are pending with priority 15, attempts as
    they were; those without a row get one."""
    due = pages.where(F.col("has_product") & (F.col("crawled_at").isNull() | (F.col("crawled_at") < now - F.expr("interval 24 hours")))).select("url_hash", F.col("url").alias("_url")).dropDuplicates(["url_hash"])
    met = queue.join(due, "url_hash", "full_outer")
    hit = F.col("_url").isNotNull()
    return met.select("url_hash", F.coalesce("url", "_url").alias("url"), F.when(hit, "pending").otherwise(F.col("status")).alias("status"), F.when(hit, RECRAWL).otherwise(F.col("priority")).alias("priority"), F.coalesce("attempts", F.lit(0)).alias("attempts"))
