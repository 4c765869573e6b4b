"""Token files: flat unsigned ids beside 64-bit document offsets, written in document order and read by memory map."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns, fresh_dir, local_path, prefix_sums, replace_file, rows, whole_texts
from .tokens import id_encoder

MANIFEST_SCHEMA = "part int, path string, n_docs long, n_ids long, width int"
INDEX_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Bytes of text that go to one file, about.
FILE_BYTES = 16 << 20


def id_width(vocabulary: int) -> int:
    """Bytes of an id in a file: 2 where every id fits, else 4."""
    return 2 if vocabulary <= 1 << 16 else 4


def _writer(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer)
        width = id_width(max(encoder.size, end_id + 1))
        end = np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        ids_path, index_path = os.path.join(folder, f"part-{part:06d}.ids"), os.path.join(folder, f"part-{part:06d}.idx")
        names: list[int | None] = []
        offsets = [0]

        def encoded() -> Iterator[bytes]:
            for doc_ids, texts in columns(batches, "doc_id", "text"):
                for doc_id, data in zip(doc_ids.to_pylist(), encoder.encode_batch(texts)):
                    data += end
                    names.append(doc_id)
                    offsets.append(offsets[-1] + len(data) // 4)
                    yield np.frombuffer(data, "<u4").astype(f"<u{width}").tobytes()

        replace_file(ids_path, encoded())
        if names:
            known = np.array([n is not None for n in names], "<u1")
            replace_file(index_path, [np.array(offsets, "<i8").tobytes(), np.array([n or 0 for n in names], "<i8").tobytes(), known.tobytes()])
            yield pa.RecordBatch.from_pylist([{"part": part, "path": ids_path, "n_docs": len(names), "n_ids": offsets[-1], "width": width}], pa.schema([("part", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("width", pa.int32())]))

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Write ``docs`` as token files and return their manifest.

    Documents are laid out by range in ascending doc_id (null first; equal ids by
    text), each followed by ``end_id``; null and empty texts are the end id alone. A
    file ``part-N.ids`` holds little-endian unsigned ids of 2 or 4 bytes; ``part-N.idx``
    holds n+1 signed 64-bit offsets in ids, n document ids, and n bytes that are 0 for
    a null id. The base of a file among all ids is the prefix sum of n_ids in the order
    of ``part``. A retried task writes the same file again and moves it into place.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    folder = folder or fresh_dir(spark, "token-files")
    docs = whole_texts(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(1, -(-size // FILE_BYTES))
    ordered = docs.repartitionByRange(int(files), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = ordered.mapInArrow(_writer(local_path(folder), tokenizer, end_id), MANIFEST_SCHEMA)
    path = f"{folder}/manifest"
    manifest.write.parquet(path)
    return spark.read.schema(MANIFEST_SCHEMA).parquet(path)


def open_tokens(path: str, n_docs: int, n_ids: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Memory maps of a file's ids, offsets, document ids, and which of these are not null."""
    ids = np.memmap(path, f"<u{width}", "r", shape=(n_ids,))
    index = path.removesuffix(".ids") + ".idx"
    offsets = np.memmap(index, "<i8", "r", shape=(n_docs + 1,))
    names = np.memmap(index, "<i8", "r", offset=8 * (n_docs + 1), shape=(n_docs,))
    known = np.memmap(index, "<u1", "r", offset=8 * (2 * n_docs + 1), shape=(n_docs,))
    return ids, offsets, names, known


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for found in rows(batches, "path", "n_docs", "n_ids", "width", "base"):
        for path, n_docs, n_ids, width, base in zip(*found):
            ids, offsets, names, known = open_tokens(path, n_docs, n_ids, width)
            sums = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array(names), pa.int64(), mask=np.array(known) == 0), pa.array(offsets[:-1] + base, pa.int64()), pa.array(np.diff(offsets), pa.int64()), pa.array(sums, pa.int64())],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_token_index(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the mapped files; start counts ids over all files before."""
    return prefix_sums(manifest, "part", "n_ids", "base").repartition(F.col("part")).mapInArrow(_reader, INDEX_SCHEMA)
