"""Streaming pipelines: raw pages from files, micro-batches, keyed upserts into Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import reachable
from ..operators import ingest

RAW = "page_id long, url string, html string"


def process(raw_pages: DataFrame) -> DataFrame:
    """Raw pages parsed and gated: url, url_hash, title, content_text, language, word_count, content_hash, reason."""
    parsed = ingest.parse_raw(raw_pages)
    gated = ingest.gate_pages(parsed)
    return gated.select("url", "url_hash", "title", "content_text", "language", "word_count", "content_hash", F.coalesce("error", "reason").alias("reason"))


def ingest_stream(spark: SparkSession, source: str, target: str, checkpoint: str, *, files: int = 10) -> None:
    """Reads new Parquet files below source, a few a batch, until none is left; each batch is written under its own number,
    so that a batch that is run again after a failure replaces itself."""
    reachable(spark)

    def write(batch: DataFrame, number: int) -> None:
        process(batch).write.mode("overwrite").parquet(f"{target}/batch={number}")

    stream = spark.readStream.schema(RAW).option("maxFilesPerTrigger", files).parquet(source)
    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest_pages(spark: SparkSession, target: str) -> DataFrame:
    """What the stream has indexed: the last batch's row of each URL hash; duplicates across batches lose to the first URL."""
    rows = spark.read.parquet(target)
    last = ingest.keep_latest(rows, ["url_hash"], ["batch"])
    keep = last.where("reason is null").groupBy("content_hash").agg(F.min("url_hash").alias("_first"))
    return last.join(keep, "content_hash", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("url_hash") != F.col("_first"), "duplicate content"))).drop("_first")

