"""Fetching: a Python data source that replays stored pages, fetch gates, politeness, and concurrent fetching by host."""

from __future__ import annotations

import json
import random
import time
import urllib.request
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accepted types, most bytes of a body and characters of headers, seconds to wait, redirects to follow.
TYPES, MOST_BYTES, MOST_HEADERS, TIMEOUT = ("text/html", "application/xhtml+xml"), 2 * 1024 * 1024, 4000, 10
RESULT = "url string, status int, body string, response_time_ms long, content_type string, headers string, error string, skipped_reason string"


def gate(content_type: Column, size: Column) -> Column:
    """Why a response is skipped: non_html_content_type (an empty type passes) or too_large; else null."""
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    html = F.exists(F.array(*[F.lit(t) for t in TYPES]), lambda t: F.contains(kind, t))
    return F.when((kind != "") & ~html, "non_html_content_type").when(size > MOST_BYTES, "too_large")


def headers_json(headers: Column) -> Column:
    """A map of header to values as JSON text, values joined, cut to 4,000 characters."""
    return F.substring(F.to_json(F.transform_values(headers, lambda _, v: F.array_join(v, ", "))), 1, MOST_HEADERS)


def fetch_one(url: str, agent: str, get: Callable = urllib.request.urlopen, types: tuple[str, ...] = TYPES) -> dict:
    """One GET, read in pieces up to the limit; failures are rows, not exceptions. Without types, any type is read."""
    out = dict.fromkeys(("status", "body", "response_time_ms", "content_type", "headers", "error", "skipped_reason")) | {"url": url}
    began = time.monotonic()
    try:
        with get(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=TIMEOUT) as r:
            kind = r.headers.get("Content-Type", "")
            out |= {"status": r.status, "content_type": kind, "headers": json.dumps({k: v for k, v in r.headers.items()})[:MOST_HEADERS]}
            if kind and types and not any(t in kind.lower() for t in types):
                out["skipped_reason"] = "non_html_content_type"
            else:
                body = r.read(MOST_BYTES + 1)
                out |= {"skipped_reason": "too_large"} if len(body) > MOST_BYTES else {"body": body.decode("utf-8", "replace")}
    except (OSError, ValueError) as e:
        out["error"] = str(e)[:500]
    return out | {"response_time_ms": int((time.monotonic() - began) * 1000)}


def fetch(urls: DataFrame, *, agent: str, concurrency: int = 5, delay_ms: int = 200, partitions: int = 15, get: Callable = urllib.request.urlopen, types: tuple[str, ...] = TYPES) -> DataFrame:
    """urls (host, url) to RESULT. Hosts are dealt to partitions, so that one task keeps a host's delay (with 20 % jitter);
    within a task, up to `concurrency` hosts are asked at a time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split(" ")[0] for c in RESULT.split(", ")]

        def host(group: pd.DataFrame) -> list[dict]:
            out = []
            for url in group["url"]:
                if out:
                    time.sleep(delay_ms / 1000 * random.uniform(0.8, 1.2))
                out.append(fetch_one(url, agent, get, types))
            return out

        with ThreadPoolExecutor(concurrency) as pool:
            for frame in frames:
                rows = [r for got in pool.map(host, [g for _, g in frame.groupby("host", dropna=False)]) for r in got]
                yield pd.DataFrame(rows, columns=columns)

    return urls.select("host", "url").repartition(partitions, "host").mapInPandas(run, RESULT)


def replay(urls: DataFrame, pages: DataFrame, key: str = "url") -> DataFrame:
    """The fetcher's result from stored pages (url, html), one row for each of urls: what isn't stored is a 404. Requests
    and stored pages meet by the key, which comes first in the result; of several pages with one key the least html counts."""
    own = pages.groupBy(F.col(key).alias("_key")).agg(F.min("html").alias("html"))
    met = urls.select(*dict.fromkeys((key, "url"))).join(own, F.col(key) == F.col("_key"), "left")
    reason = gate(F.lit("text/html"), F.octet_length("html"))
    return met.select(*dict.fromkeys((key, "url")), F.when(F.col("html").isNull(), 404).otherwise(200).alias("status"), F.when(reason.isNull(), F.col("html")).alias("body"), F.lit(0).cast("long").alias("response_time_ms"), F.lit("text/html").alias("content_type"), F.lit("{}").alias("headers"), F.lit(None).cast("string").alias("error"), F.when(F.col("html").isNotNull(), reason).alias("skipped_reason"))


def over_quota(requests: DataFrame, *, key: str, at: str, per_minute: int) -> DataFrame:
    """Minutes in which a key asked more often than its quota: key, minute, n."""
    minute = F.date_trunc("minute", F.col(at))
    return requests.groupBy(F.col(key).alias("key"), minute.alias("minute")).agg(F.count("*").alias("n")).where(F.col("n") > per_minute)
