"""Media columns: payloads as samples in archive directories, read by a custom Spark data source.

Written form: each payload is an 8-bit greyscale PNG, rows of ``width`` samples, and the PNGs
are stored members of zip archives of at most ``ARCHIVE_BYTES`` and one member, in one folder of the shared store.
PNG keeps the samples without loss and is a function of the payload alone, so equal texts have
equal stored bytes.  The archive's own directory lists every member's offset.

Reading: the driver only lists the archives and their sizes and plans partitions of byte ranges;
a member belongs to the range in which its local header starts.  A task reads the directory of
its archive, streams its members in batches of bounded bytes through Arrow, and reads a member
that fails (a short read, a wrong checksum) again by its offset, without touching the others.

Defined results: a null text is the empty text and becomes one row of pads; a null doc_id stays
null; repeated rows stay repeated; an empty table gives an empty one; very long texts are single
members; other columns are not carried.  A write task that fails removes what it has written.
"""

from __future__ import annotations

import struct
import time
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .common import workers, shared_dir

READ_SCHEMA = "doc_id bigint, n_bytes bigint, payload binary, media binary, feature string"
WRITE_SCHEMA = "doc_id bigint, payload binary"
WIDTH = 192
#: A write task begins a new archive beyond so many stored bytes: each range of an archive reads its directory.
ARCHIVE_BYTES = 256 << 20
PAD = b"\x20"


def padded(data: bytes, width: int = WIDTH) -> bytes:
    return data + PAD * (-len(data) % width or (0 if data else width))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


SIGNATURE = b"\x89PNG\r\n\x1a\n"


def to_png(payload: bytes, width: int = WIDTH) -> bytes:
    """A greyscale PNG whose rows are the payload; every row has filter 0 in front."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    raw = np.zeros((len(rows), width + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + _chunk(b"IEND", b"")


def from_png(media: bytes) -> np.ndarray:
    """The samples, rows by width; raises ValueError where a checksum is wrong."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, body, shape = 8, b"", None
    while at < len(media):
        (size,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + size]
        if struct.pack(">I", zlib.crc32(kind + data)) != media[at + 8 + size : at + 12 + size]:
            raise ValueError("wrong checksum")
        if kind == b"IHDR":
            shape = struct.unpack(">II", data[:8])
        elif kind == b"IDAT":
            body += data
        at += 12 + size
    if shape is None:
        raise ValueError("no header")
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(shape[1], shape[0] + 1)
    if raw[:, 0].any():
        raise ValueError("unknown row filter")
    return raw[:, 1:]


def features(samples: np.ndarray) -> str:
    """Rows, mean, standard deviation, entropy of the samples in bits and mean difference of neighbours."""
    counts = np.bincount(samples.ravel(), minlength=256)
    n = int(counts.sum())
    values = np.arange(256)
    mean = float((counts * values).sum() / n)
    spread = float(np.sqrt(max(0.0, (counts * values**2).sum() / n - mean**2)))
    share = counts[counts > 0] / n
    entropy = float(-(share * np.log2(share)).sum())
    flat = samples.ravel().astype(np.int16)
    return f"rows={len(samples)};mean={mean:.4f};sd={spread:.4f};entropy={entropy:.4f};step={np.abs(np.diff(flat)).mean():.4f}"


def file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else "file://" + path)


class ArchiveRange(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


class ArchiveCommit(WriterCommitMessage):
    def __init__(self, paths: list[str]):
        self.paths = paths


class ArchiveWriter(DataSourceArrowWriter):
    """Archives of bounded size, written under names of their own and listed only when the job commits."""

    def __init__(self, options: dict):
        self.path, self.width = options["path"], int(options.get("width", WIDTH))
        self.archive_bytes = int(options.get("archive_bytes", ARCHIVE_BYTES))

    def write(self, batches: Iterator[pa.RecordBatch]) -> ArchiveCommit:
        store, folder = file_system(self.path)
        store.create_dir(folder, recursive=True)
        rows = ((doc, data) for batch in batches for doc, data in zip(batch["doc_id"].to_pylist(), batch["payload"].to_pylist(), strict=True))
        paths, row = [], next(rows, None)
        try:
            while row is not None:
                paths.append(f"{folder}/.{uuid.uuid4().hex}.tmp")
                with store.open_output_stream(paths[-1]) as out, zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
                    held = n = 0
                    while row is not None and held < self.archive_bytes:
                        doc, data = row
                        # a fixed time keeps archives reproducible; the name has the row's number, its id and its unpadded size
                        entry = zipfile.ZipInfo(f"{n}/{'' if doc is None else doc}/{len(data)}.png", (1980, 1, 1, 0, 0, 0))
                        media = to_png(padded(data, self.width), self.width)
                        archive.writestr(entry, media)
                        held, n, row = held + len(media), n + 1, next(rows, None)
        except BaseException:
            for p in paths:
                store.delete_file(p)
            raise
        return ArchiveCommit(paths)

    def commit(self, messages: list) -> None:
        store, folder = file_system(self.path)
        for k, m in enumerate(messages):
            for i, p in enumerate(m.paths if m is not None else []):
                store.move(p, f"{folder}/archive-{k:06d}-{i:04d}.zip")

    def abort(self, messages: list) -> None:
        store, _ = file_system(self.path)
        for m in messages:
            for p in m.paths if m is not None else []:
                store.delete_file(p)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.range_bytes = int(options.get("range_bytes", 8 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.tries = int(options.get("tries", 3))

    def partitions(self) -> list[ArchiveRange]:
        from pyarrow import fs

        store, folder = file_system(self.path)
        files = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [ArchiveRange(f.path, at, min(at + self.range_bytes, f.size)) for f in sorted(files, key=lambda f: f.path) if f.path.endswith(".zip") for at in range(0, f.size, self.range_bytes)] or [ArchiveRange("", 0, 0)]

    def member(self, source, entry: zipfile.ZipInfo) -> tuple[bytes, np.ndarray]:
        """The stored bytes and the samples of one member, by its offset, independent of all others."""
        for left in range(self.tries - 1, -1, -1):
            try:
                source.seek(entry.header_offset)
                head = source.read(30)
                name, extra = struct.unpack_from("<HH", head, 26)
                source.seek(entry.header_offset + 30 + name + extra)
                media = source.read(entry.file_size)
                if zlib.crc32(media) != entry.CRC:
                    raise ValueError("wrong checksum")
                return media, from_png(media)
            except (OSError, ValueError, struct.error, zlib.error):
                if not left:
                    raise
                time.sleep(0.1)
        raise AssertionError

    def read(self, partition: ArchiveRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        store, _ = file_system(self.path)
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload", pa.binary()), ("media", pa.binary()), ("feature", pa.string())])
        with store.open_input_file(partition.path) as source, zipfile.ZipFile(source) as archive:
            mine = sorted((e for e in archive.infolist() if partition.start <= e.header_offset < partition.stop), key=lambda e: e.header_offset)
            rows, held = [], 0
            for entry in mine:
                media, samples = self.member(source, entry)
                _, doc, size = entry.filename.split("/")
                rows.append((int(doc) if doc else None, int(size.removesuffix(".png")), samples.tobytes(), media, features(samples)))
                held += len(media) + samples.size
                if held >= self.batch_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class MediaArchives(DataSource):
    """``format("media_archives")``: options path, width (write), range_bytes, batch_bytes, tries (read)."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return READ_SCHEMA

    def reader(self, schema: StructType) -> ArchiveReader:
        return ArchiveReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(dict(self.options))


def write_media(df: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", width: int = WIDTH, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write the whole texts of all rows as media archives into the folder ``path``."""
    spark = df.sparkSession
    spark.dataSource.register(MediaArchives)
    workers(spark)
    payload = F.encode(F.coalesce(df[text].cast("string"), F.lit("")), "UTF-8")
    df.select(df[doc_id].cast("long").alias("doc_id"), payload.alias("payload")).write.format("media_archives").option("width", str(width)).option("archive_bytes", str(archive_bytes)).mode("append").save(path)


def read_media(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """doc_id, n_bytes (unpadded), payload (padded), media (stored bytes), feature, one row a member."""
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").options(**options).load(path)


def media_columns(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Store all texts in a new folder of the shared store and read them back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/media-{uuid.uuid4().hex}"
    write_media(df, path, text, doc_id)
    return read_media(spark, path)
