"""Media columns: texts stored as 8-bit images in archives, read back by a Spark data source over byte ranges."""

from __future__ import annotations

import binascii
import hashlib
import io
import struct
import time
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import frugal, pick, scratch, slices, small_batches

#: Payloads are padded with this byte, which UTF-8 never uses, to a positive multiple of UNIT.
PAD, UNIT = b"\xff", 576
PNG = b"\x89PNG\r\n\x1a\n"
MEMBERS = pa.schema([("doc_id", pa.int64()), ("archive", pa.string()), ("at", pa.int64()), ("media", pa.binary()), ("error", pa.string())])
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("error", pa.string())])


# ------------------------------------------------------------------ the form of one member

def pad(text: bytes) -> bytes:
    return text + PAD * (UNIT - len(text) % UNIT if len(text) % UNIT or not text else 0)


def to_image(payload: bytes) -> bytes:
    """An 8-bit grey PNG, UNIT samples wide; each sample is a byte of the payload. Rows are not filtered."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", binascii.crc32(kind + data))
    return PNG + chunk(b"IHDR", struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 3)) + chunk(b"IEND", b"")


def from_image(media: bytes) -> bytes:
    """The samples of a grey 8-bit PNG with unfiltered rows, as to_image() writes it. Damage raises ValueError."""
    if media[:8] != PNG:
        raise ValueError("not a PNG")
    at, data, shape = 8, [], None
    while at + 12 <= len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(body) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", binascii.crc32(kind + body)):
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    if shape is None or shape[2:] != (8, 0, 0, 0, 0):
        raise ValueError("not an 8-bit grey image")
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(shape[1], shape[0] + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Of the samples: mean, standard deviation and edge energy (mean absolute step), to 4 places, and a 4-bin histogram."""
    x = np.frombuffer(payload, np.uint8)
    step = np.abs(np.diff(x.astype(np.int16))).mean()
    return f"mean={x.mean():.4f};std={x.std():.4f};edge={step:.4f};hist={','.join(map(str, np.bincount(x >> 6, minlength=4)))}"


# ------------------------------------------------------------------ archives

def _open(url: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(url)


def _write_part(folder: str, limit: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        task = TaskContext.get()
        part, attempt, k, zf = task.partitionId(), task.taskAttemptId(), 0, None

        def close() -> pa.RecordBatch:
            nonlocal zf, k
            n = len(zf.filelist)
            zf.close()
            out.close()
            # Only whole archives get their names. Another attempt at the same part writes the same rows there.
            name = f"{root}/part-{part:06d}-{k:04d}.zip"
            fs.move(f"{root}/_tmp/{part}-{attempt}-{k}", name)
            zf, k = None, k + 1
            return pa.RecordBatch.from_pylist([{"archive": f"part-{part:06d}-{k - 1:04d}.zip", "members": n}])

        for batch in slices(batches):
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                if zf is None:
                    out = fs.open_output_stream(f"{root}/_tmp/{part}-{attempt}-{k}")
                    zf = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED)
                # A fixed date, so that equal rows give equal archives.
                zf.writestr(zipfile.ZipInfo(f"{'null' if doc_id is None else doc_id}.png", (1980, 1, 1, 0, 0, 0)), to_image(pad(text.as_py())))
                if out.tell() >= limit:
                    yield close()
        if zf is not None:
            yield close()

    return frugal(write)


def write_archives(docs: DataFrame, folder: str, *, id_col: str = "doc_id", text_col: str = "text", archive_mb: int = 64) -> int:
    """Stores each text of docs (null: empty) as an image in ZIP archives below folder, a URL that all machines reach.
    Returns the number of members. A part's archives are renamed into place when whole, so that a failed or repeated
    attempt leaves nothing that a reader sees. What each holds is written down in _manifest. An empty table writes none."""
    small_batches(docs.sparkSession)
    fs, root = _open(folder)
    fs.create_dir(f"{root}/_tmp", recursive=True)
    src = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    src.mapInArrow(_write_part(folder, archive_mb << 20), "archive string, members long").write.mode("overwrite").parquet(f"{folder}/_manifest")
    return _manifest(docs.sparkSession, folder).agg(F.coalesce(F.sum("members"), F.lit(0))).first()[0]


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("archive string, members long").parquet(f"{folder}/_manifest")


def check_archives(spark: SparkSession, folder: str) -> None:
    """Raises ValueError if an archive of the manifest is missing, or lists another number of members than were written.
    Tasks read the archives' directories, no payloads."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        for batch in batches:
            wrong = []
            for name, members in zip(batch["archive"].to_pylist(), batch["members"].to_pylist(), strict=True):
                try:
                    with fs.open_input_file(f"{root}/{name}") as f, zipfile.ZipFile(f) as zf:
                        found = len(zf.infolist())
                except (OSError, zipfile.BadZipFile):
                    found = -1
                if found != members:
                    wrong.append({"archive": name, "members": members, "found": found})
            yield pa.RecordBatch.from_pylist(wrong, schema=pa.schema([("archive", pa.string()), ("members", pa.int64()), ("found", pa.int64())]))

    wrong = _manifest(spark, folder).mapInArrow(compare, "archive string, members long, found long").limit(10).collect()
    if wrong:
        raise ValueError("archives that aren't as written: " + ", ".join(f"{r['archive']} ({r['found']} of {r['members']} members)" for r in wrong))


class Range(InputPartition):
    def __init__(self, archive: str, start: int, end: int):
        self.archive, self.start, self.end = archive, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.size = int(options.get("splitbytes", 16 << 20))
        self.retries = int(options.get("retries", 3))

    def partitions(self) -> list[Range]:
        """Byte ranges of the archives, from a listing alone; no archive is opened on the driver."""
        fs, root = _open(self.folder)
        files = sorted((f.path, f.size) for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if f.is_file and f.path.endswith(".zip"))
        return [Range(path, at, at + self.size) for path, n in files for at in range(0, n, self.size)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        """The members whose headers begin in the range, in batches of about 2 MB. A member that can't be read is tried
        again by its own offset, on a fresh handle; if that fails for good, its row has the error and no media."""
        if not partition.archive:
            return
        fs, _ = _open(self.folder)
        with fs.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as zf:
            own = sorted((i for i in zf.infolist() if partition.start <= i.header_offset < partition.end), key=lambda i: i.header_offset)
            rows, held = [], 0
            for info in own:
                media, error = self._member(fs, partition.archive, f, info)
                stem = info.filename.rpartition(".")[0]
                rows.append({"doc_id": None if stem == "null" else int(stem), "archive": partition.archive, "at": info.header_offset, "media": media, "error": error})
                held += len(media or b"")
                if held >= 2 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=MEMBERS)

    def _member(self, fs, archive: str, f, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        error = None
        for attempt in range(self.retries):
            try:
                if attempt:
                    time.sleep(0.05 * 2**attempt)
                    with fs.open_input_file(archive) as again:
                        return read_member(again, info), None
                return read_member(f, info), None
            except (OSError, ValueError) as e:
                error = f"{type(e).__name__}: {e}"
        return None, error


def read_member(f: io.IOBase, info: zipfile.ZipInfo) -> bytes:
    """The stored bytes of the member whose local header is at info.header_offset, checked against its CRC."""
    f.seek(info.header_offset)
    head = f.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("no member header at this offset")
    name, extra = struct.unpack_from("<HH", head, 26)
    f.seek(info.header_offset + 30 + name + extra)
    media = f.read(info.compress_size)
    if len(media) != info.compress_size or binascii.crc32(media) != info.CRC:
        raise ValueError("member is cut short or damaged")
    return media


class MediaArchives(DataSource):
    """Format media_archives: option path (a folder's URL), splitbytes, retries."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "doc_id long, archive string, at long, media binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, folder: str, **options) -> DataFrame:
    """One row for each member below folder: doc_id (null where its name is null), archive, at (its offset), media, error.
    A member that stays unreadable has its error and no media; a folder without archives gives an empty table. Repeated
    members are rows of their own."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(folder)


def _features(whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            rows = []
            for doc_id, media, error in zip(batch["doc_id"].to_pylist(), batch["media"], batch["error"].to_pylist(), strict=True):
                if whole and error is not None:
                    raise ValueError(f"the member of document {doc_id} can't be read: {error}")
                rows.append(_row(doc_id, media.as_py(), error))
            yield pa.RecordBatch.from_pylist(rows, schema=FEATURES)

    return frugal(run)


def _row(doc_id: int | None, media: bytes | None, error: str | None) -> dict:
    row = dict.fromkeys(FEATURES.names) | {"doc_id": doc_id, "error": error}
    if error is None:
        payload = from_image(media)
        row |= {"n_bytes": len(payload.rstrip(PAD)), "payload_bytes": len(payload), "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature(payload)}
    return row


def media_features(members: DataFrame, *, whole: bool = False) -> DataFrame:
    """Digests and features of each member as read_archives() gives it. A member with an error keeps it, all else null;
    with `whole`, it raises ValueError instead."""
    return members.select("doc_id", "media", "error").mapInArrow(_features(whole), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")


def media_columns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Stores the texts of docs in archives below folder (default: a fresh folder below spark.checkpoint.dir), reads
    them back through the data source and returns one row for each row of docs, see media_features().

    A text is its UTF-8 bytes, padded with bytes 255 up to a positive multiple of 576, as an 8-bit grey PNG of 576
    samples a row: lossless and compressed once. The unpadded length is what precedes the trailing bytes 255, which
    UTF-8 never has. Texts are stored by the task that reads them, without a shuffle, so neither hot sources nor copies
    matter; memory is bounded by a batch of 2 MB or one text. Null texts are empty ones; null and repeated ids and
    repeated rows are members of their own; an empty table gives an empty result; other columns are ignored.

    The result is whole or there is none: an archive that lacks members raises ValueError at once, and a member that
    stays unreadable after its retries when the rows are computed.
    """
    folder = folder or scratch(docs.sparkSession, "media")
    write_archives(docs, folder, id_col=id_col, text_col=text_col)
    check_archives(docs.sparkSession, folder)
    return media_features(read_archives(docs.sparkSession, folder), whole=True)
