"""Best-fit packing of documents into sequences, certified by lower bounds and repaired by exchange."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, columns, staged, whole_texts
from .tokens import id_encoder

CAPACITY = 2048
#: Pieces packed together in one task.
ITEMS = 4096
#: Times that partitions with a gap exchange pieces and pack again.
EXCHANGES = 3

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, bound long, bins long, released boolean"


def _pieces(tokenizer: str, end_id: int, capacity: int, keep_ids: bool, cache_pieces: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = id_encoder(tokenizer, cache_pieces)
        end = np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for doc_ids, texts in columns(batches, "doc_id", "text"):
            out: list[list] = [[], [], [], [], [], []]
            for doc_id, data in zip(doc_ids.to_pylist(), encoder.encode_batch(texts)):
                data += end
                for piece, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, value in zip(out, (doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), part if keep_ids else None)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if keep_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out[:n], kinds)], names[:n])

    return run


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False, cache_pieces: int | None = None) -> DataFrame:
    """Each document's ids and ``end_id``, cut into pieces of ``capacity`` ids; ``keep_ids`` adds them as little-endian unsigned 32-bit bytes."""
    bound_batches(docs.sparkSession)
    return whole_texts(docs).mapInArrow(_pieces(tokenizer, end_id, capacity, keep_ids, cache_pieces), PIECE_SCHEMA + (", ids binary" if keep_ids else ""))


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Fewest bins that any packing needs, by two families of dual feasible functions.

    f_t maps sizes over capacity - t to the capacity, sizes under t to 0 and others to
    themselves, for t up to half the capacity; u_k maps a size x to
    floor((k+1) x / capacity) * capacity / k, or to x where (k+1) x / capacity is whole.
    The sum of images over the capacity, rounded up, is a bound for either.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    number = np.concatenate([[0], np.cumsum(counts)])
    weight = np.concatenate([[0], np.cumsum(counts * np.arange(capacity + 1))])
    t = np.arange(0, capacity // 2 + 1)
    large = number[-1] - number[capacity - t + 1]
    middle = weight[capacity - t + 1] - weight[t]
    best = int((-(-(large * capacity + middle) // capacity)).max())
    sizes = np.arange(capacity + 1, dtype=np.int64)
    for k in range(1, 33):
        whole = (k + 1) * sizes % capacity == 0
        image = np.where(whole, sizes * k, (k + 1) * sizes // capacity * capacity)
        best = max(best, -(-int((counts * image).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The bin of each item, items taken longest first, each into the fullest bin that has room."""
    bins = np.empty(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, opened = 0, 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms &= ~(1 << room)
        else:
            room, b, opened = capacity, opened, opened + 1
        bins[i] = b
        left = room - size
        if left:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


def _pack(round_no: int, capacity: int, exchange: bool):
    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], ascending=[False, True, True, True, True], kind="stable", ignore_index=True)
        lengths = group["length"].to_numpy(np.int64)
        bins = best_fit_decreasing(lengths, capacity)
        n, bound = int(bins.max()) + 1, lower_bound(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=n).astype(np.int64)
        release = np.zeros(n, bool)
        if exchange and n > bound:
            # The emptiest bins, as many as hold the room of the bins to be saved, and as many again to mix with.
            order = np.argsort(fill, kind="stable")
            room = np.cumsum(capacity - fill[order])
            release[order[: 2 * (int(np.searchsorted(room, (n - bound) * capacity)) + 1)]] = True
        order = np.argsort(bins, kind="stable")
        ends = np.cumsum(lengths[order])
        starts = ends - lengths[order]
        first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        offset = np.empty(len(bins), np.int64)
        offset[order] = starts - np.repeat(starts[first], np.diff(np.append(np.flatnonzero(first), len(bins))))
        group["sequence_id"] = (round_no << 60) + (int(key[0]) << 28) + bins
        group["offset"] = offset
        group["bound"], group["bins"], group["released"] = bound, n, release[bins]
        return group.drop(columns="part")

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, items: int = ITEMS, exchanges: int = EXCHANGES, n: int | None = None) -> DataFrame:
    """Lay pieces into sequences of at most ``capacity`` ids.

    Pieces are dealt evenly to tasks of ``items`` at most, whatever their documents.
    Each packs its own by best-fit decreasing and holds the number of bins against the
    dual-feasible bound of its lengths. Where these are equal, no packing of that task's
    pieces needs fewer, and it is done. Elsewhere the emptiest bins are given up; their
    pieces, from all such tasks, are dealt anew and packed together, ``exchanges`` times.
    Ties in length go by doc_id, piece, start and checksum. Where it is known that there
    are some ``n`` pieces, few files are written.
    """
    todo = staged(pieces, "packing-pieces", n)
    out = None
    for round_no in range(exchanges + 1):
        count = todo.count()
        if not count:
            break
        parts = -(-count // items)
        exchange = parts > 1 and round_no < exchanges
        dealt = todo.withColumn("part", F.pmod(F.monotonically_increasing_id(), F.lit(parts)))
        done = staged(dealt.groupBy("part").applyInPandas(_pack(round_no, capacity, exchange), PACKED_SCHEMA), "packing-round", count)
        kept = done.where("not released")
        out = kept if out is None else out.unionByName(kept)
        todo = done.where("released").select(pieces.columns)
        if not exchange:
            break
    if out is None:
        out = todo.sparkSession.createDataFrame([], PACKED_SCHEMA)
    return out.drop("released")


def packed_sequences(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, cache_pieces: int | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset, bound, bins) for each piece of ``docs``.

    Null and empty texts are the end id alone; a null doc_id is carried as null; rows
    that repeat are packed each. ``bound`` and ``bins`` are the certificate of the task
    that packed the piece last. ``cache_pieces`` sets how many pieces of text a worker's
    cache holds, which changes no result.
    """
    return pack(token_pieces(docs, tokenizer, end_id, capacity, cache_pieces=cache_pieces), capacity, n=docs.count())
