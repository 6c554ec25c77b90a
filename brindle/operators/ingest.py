"""Ingest: gates, exact duplicates, links, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import price as P
from ..functions import text as T
from ..functions import url as U

#: Least characters of a page's text; failures after which a raw page is given up.
LEAST_CHARS, ATTEMPTS = 100, 3


def keep_latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last by order. A single aggregation, with partial maxima before the shuffle."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("_x")).select(*keys, *[F.col("_x")[c].alias(c) for c in [*order, *rest]])


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """old and new by key: the latest row of either; the new one where all else is equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return keep_latest(both, keys, [*order, "_new"]).drop("_new").select(*old.columns)


def insert_ignore(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and those rows of new whose key is not there yet, one a key (the first by all columns)."""
    rest = [c for c in new.columns if c != key]
    fresh = new.groupBy(key).agg(F.min(F.struct(*rest)).alias("_x")).select(key, *[F.col("_x")[c].alias(c) for c in rest])
    return old.unionByName(fresh.join(old.select(key), key, "left_anti").select(*old.columns))


def gate(title: Column, text: Column) -> Column:
    """Why a parsed page isn't indexed, null if it passes."""
    return F.when(F.length(T.trim(F.coalesce(text, F.lit("")))) < LEAST_CHARS, "content too short").when(T.soft_404(title, text), "soft 404 page")


def gate_pages(pages: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """pages (url_hash, title, content_text) with reason: the gates, then duplicate content: the same text under another
    URL, here (the smallest url_hash that passes stays) or in known (content_hash, url_hash)."""
    rows = pages.withColumn("content_hash", F.sha2(F.coalesce("content_text", F.lit("")), 256)).withColumn("reason", gate(F.col("title"), F.col("content_text")))
    first = rows.where("reason is null").groupBy("content_hash").agg(F.min("url_hash").alias("_first"))
    rows = rows.join(first, "content_hash", "left")
    again = F.col("url_hash") != F.col("_first")
    if known is not None:
        seen = known.groupBy("content_hash").agg(F.min("url_hash").alias("_lo"), F.max("url_hash").alias("_hi"))
        rows = rows.join(seen, "content_hash", "left")
        again = again | (F.col("_lo").isNotNull() & ((F.col("_lo") != F.col("url_hash")) | (F.col("_hi") != F.col("url_hash"))))
    out = rows.withColumn("reason", F.coalesce("reason", F.when(again, "duplicate content")))
    return out.drop("_first", "_lo", "_hi")


def page_links(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, pos, target_url, anchor_text, is_external: first link to each crawlable URL of a page, in order."""
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("_base"), F.posexplode(H.hrefs(F.col(html_col))).alias("pos", "link"))
    src = U.once(src, "target_url", U.resolve(F.col("link.href"), F.col("_base"))).where(F.col("target_url").isNotNull())
    src = src.where(U.should_crawl(F.col("target_url")) & ~U.is_trap(F.col("target_url")))
    first = src.groupBy("page_id", "target_url").agg(F.min(F.struct("pos", F.col("link.anchor_text").alias("anchor"), "_base")).alias("x"))
    anchor = F.when(F.col("x.anchor").isin("", "0"), None).otherwise(F.col("x.anchor"))
    return first.select("page_id", F.col("x.pos").alias("pos"), "target_url", anchor.alias("anchor_text"), (U.host(F.col("target_url")) != U.host(F.col("x._base"))).alias("is_external"))


def resolve_targets(links: DataFrame, pages: DataFrame) -> DataFrame:
    """links with target_page_id: the page whose normalised URL is the target, else null; all links at once."""
    own = pages.select(U.url_hash(F.col("url")).alias("_hash"), F.col("page_id").alias("target_page_id")).groupBy("_hash").agg(F.min("target_page_id").alias("target_page_id"))
    return links.withColumn("_hash", U.url_hash(F.col("target_url"))).join(own, "_hash", "left").drop("_hash")


def parse_raw(raw_pages: DataFrame) -> DataFrame:
    """raw_pages (url, html) parsed by the Arrow function: url, url_hash and the parsed fields; error where that failed."""
    parsed = raw_pages.withColumn("p", H.parse(F.col("html"), U.bare_host(F.col("url"))))
    return parsed.select("url", U.url_hash(F.col("url")).alias("url_hash"), "p.*")


def product_prices(parsed: DataFrame) -> DataFrame:
    """url and the accepted price candidate of shop pages (nothing else is looked at)."""
    found = F.concat(F.coalesce("prices", F.array().cast(f"array<{P.CANDIDATE}>")), F.array(P.from_text(F.coalesce("content_text", F.lit("")))))
    return parsed.where(U.is_shop(F.col("url"))).select("url", P.best(found).alias("x")).where("x is not null").select("url", "x.*")


def after_failure(raw_pages: DataFrame) -> DataFrame:
    """Attempts counted; given up (processed) after three."""
    return raw_pages.withColumn("attempts", F.col("attempts") + 1).withColumn("processed", F.col("attempts") >= ATTEMPTS)
