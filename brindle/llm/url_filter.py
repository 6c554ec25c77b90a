"""URL filters: host-suffix and path-prefix expressions, joined to the rules on short hash prefixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, pick

#: Host, path and verdict of the default rules.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: then up to ? # or the end.
    A null url, or one without ://, has neither."""
    safe = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(safe, SPLIT, 1)), F.regexp_extract(safe, SPLIT, 2)


def expressions(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """Every host suffix of up to `labels` labels with every path prefix of the given lengths, as one string each."""
    parts = F.split(host, r"\.", -1)
    n = F.size(parts)
    suffixes = F.transform(F.sequence(F.greatest(F.lit(1), n - labels + 1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))
    prefixes = F.transform(F.filter(F.array(*[F.lit(k) for k in lengths]), lambda k: k <= F.length(path)), lambda k: F.substring(path, F.lit(1), k))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame([tuple(r) for r in rules], "host string, path string, verdict string")


def judge_urls(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", prefix_hex: int = 8, default: str = "allow", broadcast_mb: float = 8.0) -> DataFrame:
    """One row for each row of pages: the id (as page_id), host, path, rule and verdict.

    rules: host, path, verdict (allow or block). A rule fits its host and all subdomains if the url's path starts
    with the rule's path. The longest rule (host and path together) wins; among equals the longer host, then block.
    Without a fitting rule, rule is null and the verdict is `default`.

    Each url is expanded into its host suffixes (no more labels than the longest rule host has) with its path prefixes
    (of the lengths that rule paths have). Expressions meet the rules in an equi-join on the first `prefix_hex` hex
    digits of their SHA-256; then full digests are compared, and precedence is decided in one aggregation by row. All
    expressions of a row are produced by the same task, so that the map-side aggregation leaves one record a row before
    the shuffle, and the shuffle key is the row itself: a host with a third of all rows makes no hot partition. The
    rules are broadcast only if they measure at most `broadcast_mb`; beyond that the join shuffles, and AQE splits hot keys.

    Null or odd urls: empty host and path, no rule. Null ids, repeated ids and repeated rows: judged row by row.
    Empty tables of pages or rules: an empty result, or the default verdict. Other columns are ignored.
    Rules with a null host, path or verdict fit nothing. Repeated rules count once.
    """
    own = pick(rules, host="host", path="path", verdict="verdict").dropna().distinct().select(lower_ascii(F.col("host")).alias("rule_host"), F.col("path").alias("rule_path"), "verdict")
    own = own.withColumn("rule", F.concat("rule_host", "rule_path")).withColumn("rule_digest", F.sha2("rule", 256)).withColumn("prefix", F.substring("rule_digest", 1, prefix_hex))
    # One row comes to the driver; the distinct lengths are bounded by the longest rule path.
    shape = own.agg(F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"), F.sort_array(F.collect_set(F.length("rule_path"))).alias("lengths"), F.sum(F.octet_length("rule") + 120).alias("bytes")).first()
    src = pick(pages, page_id=id_col, url=url_col)
    host, path = host_and_path(F.col("url"))
    src = src.select("page_id", host.alias("host"), path.alias("path"))
    if not shape["labels"]:
        return src.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    own = own.select("prefix", "rule_digest", "rule", "verdict", F.length("rule").alias("rule_len"), F.length("rule_host").alias("host_len"))
    if shape["bytes"] <= broadcast_mb * 1e6:
        own = F.broadcast(own)
    asked = src.withColumn("row", F.monotonically_increasing_id()).select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), shape["labels"], shape["lengths"])).alias("expr"))
    asked = asked.withColumn("digest", F.sha2("expr", 256)).withColumn("prefix", F.substring("digest", 1, prefix_hex)).drop("expr")
    found = asked.join(own, "prefix", "left")
    best = F.max(F.when(F.col("digest") == F.col("rule_digest"), F.struct("rule_len", "host_len", (F.col("verdict") == "block").alias("block"), "rule", "verdict")))
    judged = found.groupBy("row", "page_id", "host", "path").agg(best.alias("best"))
    return judged.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))
