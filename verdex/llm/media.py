"""Media columns: payloads kept as 8-bit images in archives, read back by a data source in byte ranges."""

from __future__ import annotations

import hashlib
import os
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import bound_batches, fresh_dir, local_path, replace_file, rows, whole_texts

WIDTH = 192
LEVEL = 1
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
ATTEMPTS = 3
MAGIC = b"VXMEDIA1"
#: mark, payload's unpadded bytes, stored bytes, doc_id, whether doc_id is known, checksum of the fields before and the stored bytes
HEADER = struct.Struct("<4sQQqBI")
FOOTER = struct.Struct("<QQ8s")
MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, width: int = WIDTH) -> bytes:
    """A grey 8-bit PNG of ``width`` samples a row that holds the payload, a positive multiple of the width."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(samples), width + 1), np.uint8)
    lines[:, 1:] = samples
    header = struct.pack(">IIBBBBB", width, len(samples), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> bytes:
    """The samples of an image that :func:`to_image` made; ValueError if it is damaged."""
    if image[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not an image")
    at, width, data = 8, 0, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        body = image[at + 8 : at + 8 + size]
        if zlib.crc32(kind + body) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError(f"damaged chunk {kind!r}")
        if kind == b"IHDR":
            width = struct.unpack(">I", body[:4])[0]
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)[:, 1:].tobytes()


def padded(text: str, width: int = WIDTH) -> tuple[bytes, int]:
    data = text.encode("utf-8")
    return data + b" " * (max(1, -(-len(data) // width)) * width - len(data)), len(data)


def _sum(header: bytes, image: bytes) -> int:
    return zlib.crc32(image, zlib.crc32(header[: HEADER.size - 4]))


def _member(n: int, doc_id: int | None, image: bytes) -> bytes:
    header = HEADER.pack(b"MEMB", n, len(image), doc_id or 0, doc_id is not None, 0)
    return header[:-4] + struct.pack("<I", _sum(header, image)) + image


def _directory(offsets: list[int], at: int) -> bytes:
    return np.array(offsets, "<u8").tobytes() + FOOTER.pack(at, len(offsets), MAGIC)


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = os.path.join(folder, f"part-{TaskContext.get().partitionId():06d}.arc")
        offsets: list[int] = []
        size = len(MAGIC)

        def parts() -> Iterator[bytes]:
            nonlocal size
            yield MAGIC
            for ids, texts in rows(batches, "doc_id", "text"):
                for doc_id, text in zip(ids, texts):
                    payload, n = padded(text)
                    member = _member(n, doc_id, to_image(payload))
                    offsets.append(size)
                    size += len(member)
                    yield member
            yield _directory(offsets, size)

        total = replace_file(path, parts())
        yield pa.RecordBatch.from_pylist([{"path": path, "n_members": len(offsets), "n_bytes": total}], pa.schema([("path", pa.string()), ("n_members", pa.int64()), ("n_bytes", pa.int64())]))

    return run


def write_archives(docs: DataFrame, folder: str | None = None) -> str:
    """Keep each document's payload as a member of an archive, one archive a partition; returns the folder.

    An archive is a magic word, members (a header, then the image), a directory of
    64-bit member offsets, and a footer that says where the directory is.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or fresh_dir(spark, "media")
    whole_texts(docs).mapInArrow(_archive(local_path(folder)), "path string, n_members long, n_bytes long").write.parquet(f"{folder}/manifest")
    return folder


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int) -> None:
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


class MediaArchives(DataSource):
    """``spark.read.format("media_archives").load(folder)``: (doc_id, n_bytes, media) of every member.

    Options: ``split_bytes``, ``attempts``.
    """

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return MEDIA_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return MediaReader(self.options)


class MediaReader(DataSourceReader):
    def __init__(self, options) -> None:
        self.folder = local_path(options["path"])
        self.split_bytes = int(options.get("split_bytes", SPLIT_BYTES))
        self.attempts = int(options.get("attempts", ATTEMPTS))
        self.opened = None

    def partitions(self) -> list[ByteRange]:
        """Byte ranges by file sizes alone; a member belongs to the range that its offset lies in."""
        out = []
        with os.scandir(self.folder) as found:
            for entry in sorted(found, key=lambda e: e.name):
                if entry.name.endswith(".arc"):
                    size = entry.stat().st_size
                    out += [ByteRange(entry.path, at, min(size, at + self.split_bytes)) for at in range(0, size, self.split_bytes)]
        return out or [ByteRange("", 0, 0)]

    def _file(self, path: str):
        """The archive being read; it stays open from member to member."""
        if self.opened is None or self.opened[0] != path:
            self._close()
            self.opened = path, open(path, "rb")
        return self.opened[1]

    def _close(self) -> None:
        if self.opened is not None:
            self.opened[1].close()
            self.opened = None

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        try:
            yield from self._read(partition)
        finally:
            self._close()

    def _read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        ids, sizes, media, held = [], [], [], 0
        for offset in self.offsets(partition) if partition.path else ():
            doc_id, n, image = self.member(partition.path, offset)
            ids.append(doc_id)
            sizes.append(n)
            media.append(image)
            held += len(image)
            if held >= BATCH_BYTES:
                yield self.batch(ids, sizes, media)
                ids, sizes, media, held = [], [], [], 0
        if ids:
            yield self.batch(ids, sizes, media)

    @staticmethod
    def batch(ids: list, sizes: list, media: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    @staticmethod
    def offsets(partition: ByteRange) -> list[int]:
        with open(partition.path, "rb") as f:
            f.seek(-FOOTER.size, os.SEEK_END)
            at, n, magic = FOOTER.unpack(f.read(FOOTER.size))
            if magic != MAGIC:
                raise ValueError(f"{partition.path} has no directory")
            f.seek(at)
            found = np.frombuffer(f.read(8 * n), "<u8")
        return found[(found >= partition.start) & (found < partition.end)].tolist()

    def member(self, path: str, offset: int) -> tuple[int | None, int, bytes]:
        """One member by its offset, checked and tried again by itself on a file opened anew: what was read of the others stays."""
        for attempt in range(self.attempts):
            try:
                f = self._file(path)
                f.seek(offset)
                header = f.read(HEADER.size)
                kind, n, size, doc_id, known, checksum = HEADER.unpack(header)
                if kind != b"MEMB":
                    raise ValueError("no member")
                image = f.read(size)
                if len(image) != size or _sum(header, image) != checksum:
                    raise ValueError("cut short or damaged")
                return (doc_id if known else None), n, image
            except (OSError, ValueError, struct.error, MemoryError, OverflowError) as e:
                self._close()
                if attempt + 1 == self.attempts:
                    raise ValueError(f"{path} at {offset}: {e}") from e
                time.sleep(0.05 * 2**attempt)
        raise AssertionError


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(MediaArchives)
    return spark.read.format("media_archives").load(folder)


def image_features(payload: bytes) -> str:
    """Mean, deviation, share of zero-difference neighbours and sixteen-bin histogram of the samples, as text."""
    samples = np.frombuffer(payload, np.uint8)
    bins = np.bincount(samples >> 4, minlength=16) * 1000 // len(samples)
    return f"{samples.mean():.3f};{samples.std():.3f};{(samples[1:] == samples[:-1]).mean():.4f};" + ",".join(map(str, bins.tolist()))


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for ids, sizes, media in rows(batches, "doc_id", "n_bytes", "media"):
        out = []
        for doc_id, n, image in zip(ids, sizes, media):
            payload = from_image(image)
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(image), hashlib.sha256(image).hexdigest(), image_features(payload)))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(map(list, zip(*out)), kinds)], names)


def media_columns(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of each document.

    A payload is the text as UTF-8 (null: empty) and spaces up to a positive multiple of
    WIDTH bytes, stored as a grey image; every value but n_bytes and doc_id comes from
    the bytes read back. Rows that repeat are stored and measured each; an empty table
    gives no rows.
    """
    folder = write_archives(docs, folder)
    return read_archives(docs.sparkSession, folder).mapInArrow(
        _measure, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
