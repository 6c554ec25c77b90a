"""Analytics and maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import url as U


def dashboard(pages: DataFrame, domains: DataFrame, queue: DataFrame, crawl_logs: DataFrame, search_logs: DataFrame, now: Column) -> DataFrame:
    """One row of counts. Each table is read once; the parts are single rows."""
    hour = (F.col("crawled_at") >= now - F.expr("interval 1 hour")) & (F.col("crawled_at") <= now) & F.col("page_id").isNotNull()
    parts = [
        pages.agg(F.count("*").alias("pages"), F.count_if(F.col("status") == "indexed").alias("indexed_pages")),
        domains.agg(F.count("*").alias("domains"), F.count_if(F.col("status") == "active").alias("active_domains")),
        queue.agg(*[F.count_if(F.col("status") == s).alias(f"queue_{s}") for s in ("pending", "processing", "done", "failed")]),
        crawl_logs.agg(F.count_if(hour).alias("crawled_last_hour")),
        search_logs.agg(F.count_if((F.to_date("searched_at") == F.to_date(now)) & (F.col("searched_at") <= now)).alias("searches_today")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(F.broadcast(p))  # one row each
    return out


def per_day(rows: DataFrame, at: str, now: Column, days: int = 30) -> DataFrame:
    """Rows a day since now less 30 days; days without rows are absent."""
    return rows.where(F.col(at) >= now - F.make_dt_interval(days=F.lit(days))).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("n"))


def popular(search_logs: DataFrame, now: Column, limit: int = 10) -> DataFrame:
    own = search_logs.where(F.col("searched_at") >= now - F.expr("interval 30 days"))
    return own.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query").limit(limit)


def recent(search_logs: DataFrame, limit: int = 50) -> DataFrame:
    return search_logs.select("id", "query", "results_count", "searched_at").orderBy(F.col("searched_at").desc(), F.col("id").desc()).limit(limit)


def products_per_domain(prices: DataFrame, domains: DataFrame) -> DataFrame:
    own = domains.select(F.col("id").alias("domain_id"), "name")
    return prices.groupBy("domain_id").agg(F.count_distinct("product_id").alias("products")).join(own, "domain_id").select("name", "products")


def success_rate(pages: DataFrame) -> DataFrame:
    """Pages with a product over pages fetched, to four places; 0 if none was."""
    got = F.count_if(F.col("has_product") & F.col("http_status").isNotNull())
    return pages.agg(F.coalesce(F.round(F.try_divide(got, F.count("http_status")), 4), F.lit(0.0)).alias("rate"))


def status_counts(rows: DataFrame, statuses: list[str]) -> DataFrame:
    return rows.agg(*[F.count_if(F.col("status") == s).alias(s) for s in statuses])


def with_counts(domains: DataFrame, queue: DataFrame) -> DataFrame:
    """domains with their pending and failed queue rows, 0 if none."""
    n = queue.groupBy("domain_id").agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "failed").alias("failed"))
    return domains.join(n, domains["id"] == n["domain_id"], "left").select("id", "name", F.coalesce("pending", F.lit(0)).alias("pending"), F.coalesce("failed", F.lit(0)).alias("failed"))


def page_of(rows: DataFrame, order: list[Column], page: int, per_page: int = 25) -> DataFrame:
    return rows.orderBy(*order).offset((page - 1) * per_page).limit(per_page)


def throughput(rows: DataFrame, at: str, since: Column, until: Column, target: int = 1_000_000) -> DataFrame:
    """One row: rows up to either instant (a, b), rows a minute between, minutes to the target (null at a standstill)."""
    n = rows.agg(F.count_if(F.col(at) <= since).alias("a"), F.count_if(F.col(at) <= until).alias("b"))
    rate = (F.col("b") - F.col("a")) / (F.unix_seconds(until.cast("timestamp")) - F.unix_seconds(since.cast("timestamp"))) * 60
    return n.select("a", "b", rate.alias("per_minute"), F.try_divide(F.greatest(F.lit(0), target - F.col("b")).cast("double"), rate).alias("minutes_left"))


def duration(minutes: float) -> str:
    return f"{int(minutes) // 60}h {int(minutes) % 60}m"


# ------------------------------------------------------------------ maintenance

def keep_oldest(pages: DataFrame) -> DataFrame:
    """ids of pages whose content an older page has (by crawled_at, then id). Each content's oldest page is a pre-aggregated
    minimum, so that content which a third of all pages share is sorted by no task."""
    own = pages.where("content_hash is not null").select("id", "content_hash", F.struct("crawled_at", "id").alias("_at"))
    first = own.groupBy("content_hash").agg(F.min("_at").alias("_first"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    return own.join(first, "content_hash").where("_at <> _first").select("id", "content_hash")


def junk_pages(pages: DataFrame) -> DataFrame:
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    odd = (kind != "") & ~F.contains(kind, F.lit("text/html")) & ~F.contains(kind, F.lit("application/xhtml+xml"))
    return pages.where(U.blocked_extension(F.col("url")) | odd)


def renormalize(rows: DataFrame) -> DataFrame:
    """rows (id, url, url_hash) with new_url, new_hash and action: keep, rewrite, or delete on a collision. Of rows with
    the same new hash, one that has it already stays, else the smallest id."""
    n = rows.withColumn("new_url", U.normalize(F.col("url"))).withColumn("new_hash", F.sha2("new_url", 256))
    first = n.groupBy("new_hash").agg(F.min(F.struct((F.col("url_hash") != F.col("new_hash")).alias("moves"), "id")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select("new_hash", "_first")
    later = F.col("_first").isNotNull() & (F.col("id") != F.col("_first.id"))
    return n.join(first, "new_hash", "left").withColumn("action", F.when(later, "delete").when(F.col("url_hash") == F.col("new_hash"), "keep").otherwise("rewrite")).select(*n.columns, "action")


def junk_queue(queue: DataFrame) -> DataFrame:
    return queue.where((F.col("status") == "pending") & (~U.should_crawl(F.col("url")) | U.is_trap(F.col("url"))))


def queue_duplicates(queue: DataFrame) -> DataFrame:
    first = queue.groupBy("url_hash").agg(F.min("id").alias("_first"))
    return queue.join(first, "url_hash").where("id <> _first").drop("_first")


def cleanup_counts(pages: DataFrame, queue: DataFrame) -> DataFrame:
    """A dry run: what each pass would do to the tables as they are; passes overlap."""
    count = lambda df, name: df.agg(F.count("*").cast("long").alias("n")).select(F.lit(name).alias("pass"), "n")
    pages_again, queue_again = (renormalize(df.select("id", "url", "url_hash")) for df in (pages, queue))
    parts = [count(keep_oldest(pages), "duplicate_pages"), count(junk_pages(pages), "junk_pages")]
    for name, again in (("pages", pages_again), ("queue", queue_again)):
        parts.append(again.agg(F.count_if(F.col("action") == "rewrite").alias("rewrite"), F.count_if(F.col("action") == "delete").alias("delete")).select(F.explode(F.array(F.struct(F.lit(f"{name}_rewritten").alias("pass"), F.col("rewrite").alias("n")), F.struct(F.lit(f"{name}_collisions").alias("pass"), F.col("delete").alias("n")))).alias("x")).select("x.*"))
    parts += [count(junk_queue(queue), "junk_queue"), count(queue_duplicates(queue), "duplicate_queue")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reset_stale(queue: DataFrame, now: Column, minutes: int = 30) -> DataFrame:
    old = (F.col("status") == "processing") & (F.col("last_attempt_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return queue.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def retain(search_logs: DataFrame, now: Column, days: int = 30) -> DataFrame:
    return search_logs.where(F.col("searched_at") >= now - F.make_dt_interval(days=F.lit(days)))


def delete_domain(name: str, domains: DataFrame, pages: DataFrame, links: DataFrame, queue: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables without a domain: its pages, their links and its queue rows go; links to its pages lose their target."""
    gone = pages.where(F.col("domain") == name).select("id")
    target = gone.select(F.col("id").alias("target_page_id"), F.lit(True).alias("_gone"))
    kept = links.join(gone.select(F.col("id").alias("source_page_id")), "source_page_id", "left_anti").join(target, "target_page_id", "left")
    out = {"domains": domains.where(F.col("name") != name), "pages": pages.where(F.col("domain") != name), "links": kept.withColumn("target_page_id", F.when(F.col("_gone").isNull(), F.col("target_page_id"))).drop("_gone")}
    if queue is not None:
        ids = domains.where(F.col("name") == name).select(F.col("id").alias("domain_id"))
        out["queue"] = queue.join(F.broadcast(ids), "domain_id", "left_anti")
    return out


def edit_domain(domains: DataFrame, name: str, *, status: str | None = None, max_depth: int | None = None, crawl_delay_ms: int | None = None) -> DataFrame:
    if status not in (None, "pending", "active", "paused", "blocked") or not 1 <= (max_depth or 1) <= 50 or not 0 <= (crawl_delay_ms or 0) <= 60_000:
        raise ValueError("status pending, active, paused or blocked; max_depth 1 to 50; crawl_delay_ms 0 to 60000")
    new = {k: v for k, v in (("status", status), ("max_depth", max_depth), ("crawl_delay_ms", crawl_delay_ms)) if v is not None}
    return domains.withColumns({k: F.when(F.col("name") == name, F.lit(v)).otherwise(F.col(k)) for k, v in new.items()}) if new else domains
