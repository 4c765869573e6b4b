"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.staging import fresh_dir, gathered, staged

__all__ = ["bound_batches", "columns", "fresh_dir", "gathered", "hold_cache", "library_threads", "local_path", "prefix_sums", "replace_file", "rows", "staged", "table", "whole_texts"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: some documents are very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def local_path(uri: str) -> str:
    """The path under which a shared folder is mounted on every machine."""
    parsed = urlparse(uri)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"a mounted shared folder (file://) is needed to memory-map files, not {uri}")
    return unquote(parsed.path)


def replace_file(path: str, parts: Iterable[bytes]) -> int:
    """Write a file under a name of its own and move it into place, so that a retried task leaves one whole file."""
    os.makedirs(os.path.dirname(path), exist_ok=True)
    tmp = f"{path}.{uuid.uuid4().hex}.tmp"
    size = 0
    with open(tmp, "wb") as out:
        for part in parts:
            size += out.write(part)
    os.replace(tmp, path)
    return size


def whole_texts(docs: DataFrame) -> DataFrame:
    """doc_id and text, null text as the empty text."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))


def library_threads(on: bool) -> None:
    """Whether calls of the tokenizers library use its threads from here on; it reads this at each call, and workers are reused."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if on else "false"


#: What lets go of the cache that a Python worker keeps, by the operator that keeps it.
_HELD: dict[str, Callable[[], None]] = {}


def hold_cache(owner: str, release: Callable[[], None]) -> None:
    """Called where an operator begins in a worker: of all operators' caches only its own stays.

    Workers are reused by stage after stage; without this each would keep what all of a
    pipeline's stages ever cached, and what Arrow's allocator has ever held.
    """
    others = [name for name in _HELD if name != owner]
    for name in others:
        _HELD.pop(name)()
    _HELD[owner] = release
    if others:
        gc.collect()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL("libc.so.6").malloc_trim(0)
    pa.default_memory_pool().release_unused()


def columns(batches: Iterator[pa.RecordBatch], *names: str, least_bytes: int = 6 << 20) -> Iterator[tuple[pa.Array, ...]]:
    """Columns of batches that have rows, of ``least_bytes`` together where so many follow.

    Between them Arrow's allocator gives back what it holds unused: many times the batch after work on its pieces.
    """
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch.select(list(names)))
            size += held[-1].nbytes
        if size >= least_bytes:
            yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(len(names)))
            held, size = [], 0
            pa.default_memory_pool().release_unused()
    if held:
        yield tuple(pa.concat_arrays([b.column(i) for b in held]) for i in range(len(names)))
    pa.default_memory_pool().release_unused()


def prefix_sums(df: DataFrame, order: str, value: str, out: str, block: int = 4096) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows of a smaller ``order`` (a count from 0 on, of which each occurs at most once).

    Sums are taken inside blocks of consecutive places, each in a task of its own; only
    the sums of whole blocks meet in one window.
    """
    blocked = df.withColumn("_block", F.floor(F.col(order) / block))
    inner = Window.partitionBy("_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    whole = blocked.groupBy("_block").agg(F.sum(value).alias("_total")).select("_block", F.coalesce(F.sum("_total").over(outer), F.lit(0)).alias("_before"))
    inside = blocked.withColumn("_inside", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return inside.join(whole, "_block").withColumn(out, F.col("_before") + F.col("_inside")).drop("_block", "_before", "_inside")


def rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[list, ...]]:
    for batch in batches:
        if batch.num_rows:
            yield tuple(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)
