"""The commands of the crawler and the engine: python -m brindle STORE COMMAND, with STORE a folder's URL."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .crawler import BATCH, Crawler
from .engine import Engine
from .jobs import Schedule, crawl_page, supervise
from .sources.store import Store


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="brindle", description=__doc__)
    out.add_argument("store", help="folder that driver and executors share")
    commands = out.add_subparsers(dest="command", required=True)
    for name, text in (("seed", "queue the seeds"), ("status", "counts"), ("daily", "the daily schedule now"), ("index", "build the index"), ("schedule", "run what is due, for good")):
        commands.add_parser(name, help=text)
    add = commands.add_parser("add", help="queue URLs and their domains")
    add.add_argument("urls", nargs="+")
    add.add_argument("--priority", type=int, default=10)
    one = commands.add_parser("page", help="crawl the queue row of one URL")
    one.add_argument("url")
    for name, text in (("run", "crawl so many pages"), ("work", "crawl until nothing is left"), ("mass", "the same in large batches"), ("fetch", "fetch a batch"), ("fetch-work", "fetch until nothing is left"), ("process", "process a batch"), ("process-work", "process until nothing is left")):
        p = commands.add_parser(name, help=text)
        p.add_argument("--limit", type=int, default=10 if name == "run" else 0)
        p.add_argument("--batch", type=int, default=BATCH * 15 if name == "mass" else BATCH)
    start = commands.add_parser("start", help="both pipelines for some time")
    start.add_argument("--batch", type=int, default=BATCH)
    start.add_argument("--seconds", type=float, default=300)
    monitor = commands.add_parser("monitor", help="pages, rate and time left")
    monitor.add_argument("--target", type=int, default=1_000_000)
    cleanup = commands.add_parser("cleanup", help="duplicates and junk go")
    cleanup.add_argument("--dry-run", action="store_true")
    search = commands.add_parser("search", help="a page of results")
    search.add_argument("query")
    search.add_argument("--page", type=int, default=1)
    return out


def run(crawler: Crawler, engine: Engine, args: argparse.Namespace) -> object:
    """What a command prints."""
    name = args.command
    if name in ("work", "mass", "fetch-work", "process-work"):
        step = {"fetch-work": crawler.fetch, "process-work": crawler.process}.get(name, crawler.work)
        return supervise(lambda: step(args.batch), limit=args.limit)
    simple = {
        "seed": lambda: crawler.seed(), "add": lambda: crawler.add(args.urls, args.priority), "page": lambda: crawl_page(crawler, args.url), "run": lambda: crawler.run(args.limit, args.batch),
        "fetch": lambda: crawler.fetch(args.batch), "process": lambda: crawler.process(args.batch), "start": lambda: crawler.start(batch=args.batch, seconds=args.seconds),
        "status": lambda: crawler.status().first().asDict(), "monitor": lambda: crawler.monitor(target=args.target), "daily": lambda: crawler.daily(), "index": lambda: engine.build_index(),
        "cleanup": lambda: {r["pass"]: r["n"] for r in crawler.cleanup(args.dry_run).collect()}, "search": lambda: engine.search(args.query, page=args.page), "schedule": lambda: Schedule(crawler).run(),
    }
    return simple[name]()


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("brindle").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    store = Store(spark, args.store)
    engine = Engine(store)
    try:
        print(run(Crawler(store, changed=engine.changed), engine, args))
    finally:
        engine.flush()


if __name__ == "__main__":
    main(sys.argv[1:])
