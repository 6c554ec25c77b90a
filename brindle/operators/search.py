"""Full-text search: postings, boolean match, relevance, ranking, pages of results, suggestions, product search."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Candidates that are ranked, results a page, and the weights of the score.
CANDIDATES, PER_PAGE = 200, 10
TEXT, FRESH, QUALITY, POPULAR = 0.60, 0.15, 0.15, 0.10
TITLE_BONUS, META_BONUS, MOST_TEXT, IDEAL_WORDS, HALF_DAYS = 0.5, 0.2, 1.7, 1000, 30


# ------------------------------------------------------------------ index

def tokenize(rows: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    """id, token, pos. Columns follow one another; both sides of a match are normalised."""
    both = F.concat_ws(" ", *[T.norm_persian(F.coalesce(F.col(c), F.lit(""))) for c in columns])
    return rows.select(F.col(id_col).alias("id"), F.posexplode(T.tokens(both)).alias("pos", "token"))


def index(rows: DataFrame, *columns: str, id_col: str = "id") -> DataFrame:
    """Postings: token, id, tf, positions (sorted)."""
    return tokenize(rows, *columns, id_col=id_col).groupBy("token", "id").agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def sorted_postings(postings: DataFrame, parts: int | None = None) -> DataFrame:
    """Postings dealt and sorted by token, then id: once they are written, a term's or a prefix's filter reaches the scan
    and leaves the files and row groups whose statistics hold it. A token of many pages spans tasks."""
    spread = postings.repartitionByRange("token", "id") if parts is None else postings.repartitionByRange(parts, "token", "id")
    return spread.sortWithinPartitions("token", "id")


def write_index(rows: DataFrame, path: str, *columns: str, id_col: str = "id") -> None:
    """The index of rows below path: sorted postings, and the number of rows."""
    sorted_postings(index(rows, *columns, id_col=id_col)).write.mode("overwrite").parquet(f"{path}/postings")
    rows.agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/size")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, int]:
    """Postings and number of rows of a written index."""
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/size").first()["n"]


def atoms(postings: DataFrame, query: T.Query) -> DataFrame:
    """atom, id, tf: for each prefix the matching tokens, for each phrase the places where its words follow one another.
    Only postings of the query's words are read; the filters reach the scan."""
    parts = []
    k = 0
    for phrase in query.phrases:
        words = [w for p in phrase for w in _words(p)]
        if not words:
            continue
        seen = [postings.where(F.col("token") == w).select("id", F.explode("positions").alias("pos")).select("id", (F.col("pos") - i).alias("start")) for i, w in enumerate(words)]
        met = seen[0]
        for other in seen[1:]:
            met = met.join(other, ["id", "start"], "left_semi")
        parts.append(met.groupBy("id").agg(F.count("*").alias("tf")).select(F.lit(k).alias("atom"), "id", "tf"))
        k += 1
    for prefix in query.prefixes:
        for word in _words(prefix):
            parts.append(postings.where(F.col("token").startswith(word)).groupBy("id").agg(F.sum("tf").alias("tf")).select(F.lit(k).alias("atom"), "id", "tf"))
            k += 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _words(s: str) -> list[str]:
    return re.findall(r"[^\W_]+", T.norm_persian_text(s).lower())


def match(postings: DataFrame, query: T.Query, n_docs: int, *, bm25: tuple[float, float, DataFrame, float] | None = None) -> DataFrame:
    """id and relevance of the documents that have every atom: sum of tf * ln(N / df)^2, or BM25 (k1, b, lengths, mean)."""
    found = atoms(postings, query)
    need = sum(len(_words(w)) for w in query.prefixes) + sum(any(_words(w) for w in p) for p in query.phrases)
    df = found.groupBy("atom").agg(F.count("*").alias("df"))
    weighted = found.join(F.broadcast(df), "atom")  # one row an atom
    if bm25:
        k1, b, lengths, mean = bm25
        idf = F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
        weighted = weighted.join(lengths, "id").withColumn("w", idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / mean)))
    else:
        weighted = weighted.withColumn("w", F.col("tf") * F.pow(F.log(n_docs / F.col("df")), 2))
    return weighted.groupBy("id").agg(F.count("*").alias("n"), F.sum("w").alias("relevance")).where(F.col("n") == need).select("id", F.round("relevance", 6).alias("relevance"))


# ------------------------------------------------------------------ ranking

def text_score(relevance: Column, most: Column, title: Column, meta: Column, query: str) -> Column:
    """The query's terms are those of the normalised text as typed, quotes and operators included."""
    terms = F.array(*[F.lit(t) for t in T.norm_persian_text(query).lower().split()]) if query.split() else F.array().cast("array<string>")
    within = lambda c: F.exists(terms, lambda t: F.contains(F.lower(F.coalesce(c, F.lit(""))), t))
    return F.least(F.lit(MOST_TEXT), relevance / most + F.when(within(title), TITLE_BONUS).otherwise(0.0) + F.when(within(meta), META_BONUS).otherwise(0.0))


def freshness(crawled_at: Column, now: Column, whole_days: bool = False) -> Column:
    days = F.greatest(F.lit(0.0), F.timestamp_diff("SECOND", crawled_at, now) / 86400.0)
    return F.when(crawled_at.isNull(), 0.0).otherwise(1 / (1 + (F.floor(days) if whole_days else days) / HALF_DAYS))


def quality(words: Column, title: Column, meta: Column) -> Column:
    return 0.5 * F.least(words / IDEAL_WORDS, F.lit(1.0)) + F.when(T.filled(title), 0.25).otherwise(0.0) + F.when(T.filled(meta), 0.25).otherwise(0.0)


def popularity(backlinks: Column, most: Column) -> Column:
    return backlinks / F.greatest(F.lit(1), most)


def backlinks(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("target_page_id").alias("id")).agg(F.count("*").alias("backlinks"))


def rank(candidates: DataFrame, links: DataFrame, query: str, now: Column) -> DataFrame:
    """candidates (at most 200: relevance, title, meta_description, crawled_at, word_count) with score. Edges are counted
    for the candidates only: they are a broadcast of 200 ids."""
    ids = F.broadcast(candidates.select(F.col("id").alias("target_page_id")))
    known = backlinks(links.join(ids, "target_page_id", "left_semi"))
    both = candidates.join(known, "id", "left").withColumn("backlinks", F.coalesce("backlinks", F.lit(0)))
    every = W.partitionBy()  # over the 200 candidates
    most = F.max("relevance").over(every)
    both = both.withColumns({"_rel": F.when(most > 0, most).otherwise(1.0), "_links": F.max("backlinks").over(every)})
    score = TEXT * text_score(F.col("relevance"), F.col("_rel"), F.col("title"), F.col("meta_description"), query) + FRESH * freshness(F.col("crawled_at"), now) + QUALITY * quality(F.col("word_count"), F.col("title"), F.col("meta_description")) + POPULAR * popularity(F.col("backlinks"), F.col("_links"))
    return both.withColumn("score", F.round(score, 6)).drop("_rel", "_links")


def last_page(total: int, per_page: int = PER_PAGE) -> int:
    return max(1, math.ceil(min(total, CANDIDATES) / per_page)) if per_page > 0 else 1


def pager(page: int, last: int) -> list[int]:
    return list(range(max(1, page - 2), min(last, page + 2) + 1))


def pager_column(page: Column, last: Column) -> Column:
    """pager for columns."""
    return F.sequence(F.greatest(F.lit(1), page - 2), F.least(last, page + 2))


def validate(q: str, page: int = 1, language: str | None = None, domain: str | None = None, sort: str = "relevance") -> None:
    if not q or len(q) > 500 or page < 1 or len(language or "") > 10 or len(domain or "") > 255 or sort not in ("relevance", "date"):
        raise ValueError("q (up to 500 characters), page from 1, language up to 10, domain up to 255 characters, sort relevance or date")


def matches(pages: DataFrame, postings: DataFrame, query: str, *, n_docs: int | None = None, domain: str | None = None, language: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Indexed pages that match the query and the filters, with relevance; no content is read for them."""
    parsed = T.parse_query(T.norm_persian_text(query))
    own = pages.where(F.col("status") == "indexed")
    if domain:
        own = own.where(F.col("domain") == domain)
    if language:
        own = own.where(F.col("language") == language)
    if since:
        own = own.where(F.col("crawled_at") >= F.lit(since).cast("date").cast("timestamp_ntz"))
    if until:
        own = own.where(F.col("crawled_at") < F.date_add(F.lit(until).cast("date"), 1).cast("timestamp_ntz"))
    if parsed.empty:
        return own.limit(0).withColumn("relevance", F.lit(0.0))
    return own.join(match(postings, parsed, pages.count() if n_docs is None else n_docs), "id")


def search(pages: DataFrame, postings: DataFrame, links: DataFrame, query: str, now: Column, *, page: int = 1, per_page: int = PER_PAGE, sort: str = "relevance", **filters) -> DataFrame:
    """A page of results: position, id, title (or url), url, snippet, domain, language, crawled_at, relevance, score.

    Match, filter, keep the 200 most relevant (ties to smaller ids), rank those, slice, and only then read the content of
    the page's rows for their snippets. sort=date reorders the same 200.
    """
    validate(query, page, filters.get("language"), filters.get("domain"), sort)
    slim = pages.drop("content_text")
    top = matches(slim, postings, query, **filters).orderBy(F.col("relevance").desc(), "id").limit(CANDIDATES)
    ranked = rank(top, links, query, now)
    order = [F.col("crawled_at").desc()] if sort == "date" else []
    position = F.row_number().over(W.orderBy(*order, F.col("score").desc(), F.col("relevance").desc(), "id"))
    rows = ranked.withColumn("position", position).where((F.col("position") > (page - 1) * per_page) & (F.col("position") <= page * per_page))
    content = pages.select(F.col("id").alias("_id"), "content_text").join(F.broadcast(rows.select(F.col("id").alias("_id"))), "_id", "left_semi")
    full = rows.join(content, F.col("id") == F.col("_id"), "left")
    name = F.when(F.coalesce(F.col("title"), F.lit("")).isin("", "0"), F.col("url")).otherwise(F.col("title"))
    return full.select("position", "id", name.alias("title"), "url", T.snippet(F.col("content_text"), T.keywords(T.norm_persian_text(query))).alias("snippet"), "domain", "language", F.date_format("crawled_at", "yyyy-MM-dd'T'HH:mm:ssXXX" if dict(pages.dtypes)["crawled_at"] == "timestamp" else "yyyy-MM-dd'T'HH:mm:ss").alias("crawled_at"), "relevance", "score")


def totals(pages: DataFrame, postings: DataFrame, query: str, **filters) -> DataFrame:
    """One row: total (uncapped) and last_page."""
    n = matches(pages.drop("content_text"), postings, query, **filters).agg(F.count("*").alias("total"))
    return n.select("total", F.greatest(F.lit(1), F.ceil(F.least("total", F.lit(CANDIDATES)) / PER_PAGE)).cast("long").alias("last_page"))


def suggest(search_logs: DataFrame, prefix: str, limit: int = 5) -> DataFrame:
    """The most frequent logged queries that begin with the prefix, taken literally."""
    own = search_logs.where(F.col("query").startswith(T.norm_persian_text(prefix)))
    return own.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query").limit(limit)


# ------------------------------------------------------------------ products

def priced(products: DataFrame, prices: DataFrame) -> DataFrame:
    """products with their prices: lowest, highest, domains, and the list in order of price. Products without go."""
    own = prices.groupBy(F.col("product_id").alias("id")).agg(F.min("price").alias("lowest_price"), F.max("price").alias("highest_price"), F.count_distinct("domain_id").alias("domains_count"), F.sort_array(F.collect_list(F.struct("price", "domain_id"))).alias("prices"))
    return products.join(own, "id")


def search_products(products: DataFrame, postings: DataFrame, prices: DataFrame, query: str, *, n_docs: int | None = None, sort: str = "price_asc", limit: int = 20) -> DataFrame:
    """The 20 most relevant products, of which those with prices, by lowest price: in this order of steps."""
    if sort not in ("price_asc", "price_desc"):
        raise ValueError("sort is price_asc or price_desc")
    parsed = T.parse_query(T.norm_persian_text(query))
    if parsed.empty:
        top = products.limit(0).withColumn("relevance", F.lit(0.0))
    else:
        top = products.join(match(postings, parsed, products.count() if n_docs is None else n_docs), "id").orderBy(F.col("relevance").desc(), "id").limit(limit)
    own = prices.join(F.broadcast(top.select(F.col("id").alias("product_id"))), "product_id", "left_semi")
    out = priced(top, own)
    return out.orderBy(F.col("lowest_price").asc() if sort == "price_asc" else F.col("lowest_price").desc(), "id")


def prices_of(prices: DataFrame, domains: DataFrame | None, product_id: int) -> DataFrame:
    own = prices.where(F.col("product_id") == product_id)
    if domains is not None:
        own = own.join(domains.select(F.col("id").alias("domain_id"), F.col("name").alias("domain")), "domain_id", "left")
    return own.orderBy("price", "domain_id")
