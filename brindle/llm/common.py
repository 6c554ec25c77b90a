"""What the operators of this subpackage share: column picking, text classes, scratch storage, memory of Python tasks."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of an Arrow batch between JVM and Python, above which only a single row goes. The default, 64 MB, is held several
#: times over on both sides, outside the JVM's heap.
BATCH = 2 << 20
#: The ASCII white space that the contracts name: \x20 and \x09 to \x0D.
SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under new names. Columns are found by exact name and position, so that
    further columns whose names differ by case only, or clash with an operator's own, do no harm."""
    names = df.columns
    at = {new: names.index(old) for new, old in columns.items()}
    return df.toDF(*[f"_in{i}" for i in range(len(names))]).select(*[F.col(f"_in{i}").alias(new) for new, i in at.items()])


def packed(df: DataFrame, key: str = "_row") -> tuple[DataFrame, callable]:
    """The whole row as one struct of positional fields, and how to unpack it again under the old names."""
    names = df.columns
    inner = df.toDF(*[f"_in{i}" for i in range(len(names))])
    out = inner.select(F.struct(*[F.col(f"_in{i}") for i in range(len(names))]).alias(key))

    def unpack(frame: DataFrame, source: str = key) -> DataFrame:
        return frame.select(*[F.col(source)[f"_in{i}"].alias(f"_out{i}") for i in range(len(names))]).toDF(*names)

    return out, unpack


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder below spark.checkpoint.dir, which driver and executors share. Where the setting is
    missing (local tests), a temporary folder of this machine becomes the setting."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = Path(tempfile.mkdtemp(prefix="brindle-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def stored(df: DataFrame, tag: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here and later reads don't recompute it."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._stored_at = path
    return back


def drop(*frames: DataFrame) -> None:
    """Removes the files of stored frames that nothing reads any more."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by BATCH bytes, if they aren't bounded below that already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH:
        spark.conf.set(key, str(BATCH))


def give_back() -> None:
    """Returns freed memory to the system: workers are used again, and what their allocators keep adds up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(task: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task over batches that gives its memory back when it ends."""

    @functools.wraps(task)
    def run(batches: Iterator) -> Iterator:
        try:
            yield from task(batches)
        finally:
            give_back()

    return run


def slices(batches: Iterator, limit: int = 8 << 20) -> Iterator:
    """Arrow batches cut so that each has about `limit` bytes, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        step = max(1, int(n * limit / max(batch.nbytes, 1)))
        for at in range(0, n, step):
            yield batch.slice(at, min(step, n - at))
