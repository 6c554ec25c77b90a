"""Tables in the engine's schema, derived from the driver's tables. The rules are plain arithmetic, so that SQL can state them too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The instants that stand for now: for 30-day windows, for the last hour and today, for the crawl queue.
NOW, NOW_HOUR, NOW_QUEUE = "2024-02-05 00:00:00", "2024-01-30 12:00:00", "1998-06-01 00:00:00"


def now(s: str = NOW):
    return F.lit(s).cast("timestamp_ntz")


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as crawled pages: id, domain, url, title (first 40 characters), meta_description (every third),
    content_text, language, crawled_at (NOW less id mod 90 days), word_count, status, content_hash, has_product."""
    d = raw(spark, sf_dir, "documents")
    i = F.col("doc_id")
    return d.select(
        i.alias("id"), F.col("source").alias("domain"), F.concat(F.lit("https://"), "source", F.lit(".example.org/doc/"), i.cast("string")).alias("url"),
        F.substring("text", 1, 40).alias("title"), F.when(i % 3 == 0, F.substring("text", 41, 80)).alias("meta_description"), F.col("text").alias("content_text"), F.col("lang").alias("language"),
        (now() - F.make_dt_interval(days=(i % 90).cast("int"))).alias("crawled_at"), F.size(F.split("text", " ", -1)).cast("long").alias("word_count"),
        F.when(i % 17 == 0, "pending").otherwise("indexed").alias("status"), F.sha2("text", 256).alias("content_hash"), (i % 5 == 0).alias("has_product"),
        F.when(i % 11 == 0, F.lit(None)).otherwise(F.lit(200)).cast("int").alias("http_status"),
    )


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge from each page to page id mod 97."""
    i = F.col("doc_id")
    return raw(spark, sf_dir, "documents").select(i.alias("id"), i.alias("source_page_id"), (i % 97).alias("target_page_id"), (i % 4 == 0).alias("is_external"))


def domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of documents: id, name, pages_count, status."""
    d = raw(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("pages_count"), F.min("doc_id").alias("id"))
    return d.select("id", F.col("source").alias("name"), "pages_count", F.when(F.col("id") % 6 == 5, "paused").otherwise("active").alias("status"))


def search_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = raw(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" "), (F.col("user_id") % 20).cast("string")).alias("query"), (F.col("user_id") % 7).alias("results_count"), F.col("user_id").alias("ip"), F.col("ts").cast("timestamp_ntz").alias("searched_at"))


def crawl_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = F.col("event_type").isin("error", "click")
    return raw(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("domain_id"), F.when(bad, F.col("event_type")).alias("error_message"), F.when(~bad, F.col("event_id")).alias("page_id"), F.col("ts").cast("timestamp_ntz").alias("crawled_at"))


def crawl_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = raw(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 50).alias("domain_id"), F.concat(F.lit("https://h"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example.com/p/"), (F.col("o_orderkey") % 3000).cast("string")).alias("url"),
        F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), (F.col("o_orderkey") % 8).cast("int").alias("depth"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "pending").otherwise("processing").alias("status"),
        (F.col("o_orderkey") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"), F.col("o_orderdate").cast("timestamp_ntz").alias("last_attempt_at"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.text import norm_product

    return raw(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), norm_product(F.col("p_name")).alias("name_normalized"), F.col("p_brand").alias("brand"))


def price_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each line item: product, domain (supplier), price and when it was seen; ties by the whole row."""
    x = raw(spark, sf_dir, "lineitem")
    return x.select(F.col("l_partkey").alias("product_id"), F.col("l_suppkey").alias("domain_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("price"), F.col("l_shipdate").cast("timestamp_ntz").alias("recorded_at"), F.col("l_orderkey").alias("k1"), F.col("l_linenumber").cast("long").alias("k2"), F.round(F.col("l_quantity") * 100).cast("long").alias("k3"))


def product_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ingest import keep_latest

    # Later keys of the order decide between rows that are equal here, so they needn't be shuffled.
    seen = price_history(spark, sf_dir).select("product_id", "domain_id", "price", "recorded_at")
    return keep_latest(seen, ["product_id", "domain_id"], ["recorded_at", "price"]).select(*seen.columns)
