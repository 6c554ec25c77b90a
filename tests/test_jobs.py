"""Jobs, supervision, the schedule and the command line."""

import datetime as dt
import uuid

import pytest

from brindle import __main__ as commands
from brindle import jobs
from brindle.crawler import Crawler
from brindle.engine import Engine
from brindle.sources.store import Store, scratch

NOW = dt.datetime(2024, 1, 5, 12)


def test_supervise():
    waits = []
    replies = iter([3, OSError("lost"), OSError("lost"), 2, 0])

    def work():
        x = next(replies)
        if isinstance(x, Exception):
            raise x
        return x

    assert jobs.supervise(work, sleep=waits.append) == 5 and waits == [1, 1]
    replies = iter([3, 3, 3])
    assert jobs.supervise(work, limit=5, sleep=waits.append) == 6
    replies = iter([1, OSError("lost")])
    with pytest.raises(OSError):
        jobs.supervise(work, limit=5, sleep=waits.append)
    replies = iter([OSError("gone")] * 9)
    with pytest.raises(OSError):
        jobs.supervise(work, sleep=waits.append)


def test_schedule():
    class Quiet:
        def __init__(self):
            self.ran, self.at = [], NOW

        def clock(self):
            return self.at

        def daily(self):
            self.ran.append("daily")

        def start(self, **_):
            self.ran.append("crawl")
            assert plan.tick() == []  # no overlap

    crawler = Quiet()
    plan = jobs.Schedule(crawler)
    assert plan.tick() == ["daily", "crawl"] and plan.tick() == []
    crawler.at += dt.timedelta(seconds=301)
    assert plan.tick() == ["crawl"]
    crawler.at += dt.timedelta(days=1)
    assert plan.tick() == ["daily", "crawl"] and crawler.ran == ["daily", "crawl", "crawl", "daily", "crawl"]


def test_commands(spark, tmp_path):
    body = "a page about red bolts and blue nuts that has enough words to be indexed by the engine, and then some more "
    pages = spark.createDataFrame([("https://a.example/", f"<html lang='en'><title>Home</title><body><p>{body}</p></body></html>")], "url string, html string")
    store = Store(spark, scratch(spark, "jobs"))
    engine = Engine(store, clock=lambda: NOW)
    crawler = Crawler(store, pages=pages, clock=lambda: NOW, changed=engine.changed)
    run = lambda *argv: commands.run(crawler, engine, commands.parser().parse_args([store.root, *argv]))
    assert run("add", "https://a.example/", "--priority", "3") == 1
    assert run("page", "https://a.example/") == "done" and run("page", "https://a.example/") == "skipped" and run("page", "https://b.example/") == "skipped"
    run("index")
    assert run("search", "bolts")["results"][0]["title"] == "Home" and run("status")["pages"] == 1 and run("monitor", "--target", "5")["pages"] == 1
    with pytest.raises(SystemExit):
        commands.parser().parse_args([store.root, "nonsense"])


def test_a_failing_page_is_given_up(spark):
    store = Store(spark, scratch(spark, f"jobs-{uuid.uuid4().hex}"))

    class Broken(Crawler):
        def fetch_held(self, rows):
            raise OSError("no executor")

    crawler = Broken(store, pages=spark.createDataFrame([], "url string, html string"), clock=lambda: NOW)
    crawler.add(["https://a.example/"])
    waits = []
    with pytest.raises(OSError):
        jobs.crawl_page(crawler, "https://a.example/", tries=2, sleep=waits.append)
    row = store.read("queue").first()
    assert waits == [5] and row["status"] == "failed" and row["attempts"] == 2
