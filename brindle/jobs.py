"""Running a crawler for long: the job of one page, workers that are started again, and the schedule."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import functions as F

from .crawler import BATCH, Crawler
from .functions import url as U

#: Tries of a page's job and seconds between them; seconds between two runs of the schedule's crawl.
TRIES, BACKOFF, EVERY = 3, 5, 300


def crawl_page(crawler: Crawler, url: str, *, tries: int = TRIES, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep) -> str:
    """Crawls the queue row of one URL, whatever its priority, and returns what became of it: skipped if there is no such
    row or it is done, else the row's status. An error is tried again after a pause; after the last one the row is failed."""
    store = crawler.store
    rows = crawler.spark.createDataFrame([(url,)], "url string").select(U.url_hash(F.col("url")).alias("url_hash"))
    own = lambda: store.read("queue").join(F.broadcast(rows), "url_hash", "left_semi")
    for left in range(tries - 1, -1, -1):
        row = own().first()
        if row is None or row["status"] == "done":
            return "skipped"
        try:
            held = store.add("queue", own().withColumns({"status": F.lit("processing"), "locked_by": F.lit("job"), "attempts": F.col("attempts") + 1, "last_attempt_at": crawler.now()}))
            crawler.fetch_held(held)
            crawler.process(1)
            return own().first()["status"]
        except Exception:
            if not left:
                store.add("queue", own().withColumns({"status": F.lit("failed"), "locked_by": F.lit(None)}))
                raise
            sleep(backoff)
    raise ValueError("a job has one try at least")


def supervise(work: Callable[[], int], *, limit: int = 0, pause: float = 1, most_failures: int = 5, sleep: Callable[[float], None] = time.sleep) -> int:
    """Runs work until it returns 0, or has returned `limit` in all if that isn't 0. Without a limit it is started again
    after an error; `most_failures` errors in a row end it with the last one. Several workers of one store are a larger
    batch of one driver here: executors run its tasks side by side and repeat those that are lost."""
    done = failures = 0
    while True:
        try:
            n = work()
            failures = 0
        except Exception:
            failures += 1
            if limit or failures >= most_failures:
                raise
            sleep(pause)
            continue
        done += n
        if not n or limit and done >= limit:
            return done


class Schedule:
    """What is due when: the crawl every five minutes unless it still runs, the daily commands once a day."""

    def __init__(self, crawler: Crawler, *, batch: int = BATCH, clock: Callable[[], dt.datetime] | None = None):
        self.crawler, self.batch, self.clock = crawler, batch, clock or crawler.clock
        self.crawled: dt.datetime | None = None
        self.day: dt.date | None = None
        self.running = False

    def tick(self) -> list[str]:
        """Runs what is due now; the names of what was run. A call during another does nothing."""
        if self.running:
            return []
        self.running, now, ran = True, self.clock(), []
        try:
            if self.day != now.date():
                self.crawler.daily()
                self.day = now.date()
                ran.append("daily")
            if self.crawled is None or (now - self.crawled).total_seconds() >= EVERY:
                self.crawled = now
                self.crawler.start(batch=self.batch, seconds=EVERY, idle=0, stop=lambda: self._idle())
                ran.append("crawl")
        finally:
            self.running = False
        return ran

    def _idle(self) -> bool:
        """Whether nothing waits in the queue."""
        return self.crawler.store.read("queue").where("status = 'pending'").isEmpty()

    def run(self, *, stop: Callable[[], bool] = lambda: False, sleep: Callable[[float], None] = time.sleep) -> None:
        while not stop():
            self.tick()
            sleep(1)
