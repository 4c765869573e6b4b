"""Encoding and decoding by a sentencepiece model, rebuilt in the tokenizers library."""

from __future__ import annotations

import functools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bound_batches, hold_cache, library_threads, rows, whole_texts
from .tokens import PieceCache

UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
_BYTE_PIECE = re.compile(r"<0x[0-9A-Fa-f]{2}>")


def _varint(data: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        value |= (b & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if b < 0x80:
            return value, at


def fields(data: memoryview) -> Iterator[tuple[int, int | memoryview]]:
    """Field numbers and raw values of a protobuf message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield key >> 3, value


class ModelFile:
    """What a model file says: pieces (text, score, type), kind of model, normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            data = memoryview(f.read())
        self.pieces: list[tuple[str, float, int]] = []
        self.kind, self.byte_fallback, self.suffix_mark = UNIGRAM, False, False
        self.charsmap, self.dummy_prefix, self.squeeze, self.escape = b"", True, True, True
        for number, value in fields(data):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in fields(value):
                    if n == 1:
                        piece = bytes(v).decode("utf-8")
                    elif n == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif n == 3:
                        kind = v
                self.pieces.append((piece, score, kind))
            elif number == 2:
                spec = dict(fields(value))
                self.kind, self.byte_fallback, self.suffix_mark = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), bool(spec.get(24, 0))
            elif number == 3:
                spec = dict(fields(value))
                self.charsmap, self.dummy_prefix, self.squeeze, self.escape = bytes(spec.get(2, b"")), bool(spec.get(3, 1)), bool(spec.get(4, 1)), bool(spec.get(5, 1))


def merges(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """Pairs that make a longer piece, best score first: the merge order of a BPE model.

    A unigram model scores its pieces by likelihood; in a BPE model the score is the
    negated rank of the merge that made the piece. Among the splits of one piece, the
    order is that of the scores of the parts.
    """
    rank = {p: i for i, (p, _, kind) in enumerate(pieces) if kind in (NORMAL, USER)}
    score = {p: s for p, s, kind in pieces if kind in (NORMAL, USER)}
    found = []
    for piece in rank:
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in rank and right in rank:
                found.append((-score[piece], rank[piece], rank[left], rank[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build(path: str):
    """The tokenizer of the tokenizers library that a model file describes."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    model = ModelFile(path)
    if model.suffix_mark:
        raise ValueError("models that mark spaces as suffixes are not rebuilt")
    if any(kind == USER for _, _, kind in model.pieces):
        raise ValueError("models with user-defined pieces, which are kept whole whatever stands beside them, are not rebuilt")
    unknown = next(i for i, p in enumerate(model.pieces) if p[2] == UNKNOWN)
    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unknown, model.byte_fallback)
    elif model.kind == BPE:
        vocabulary = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocabulary, merges(model.pieces), unk_token=model.pieces[unknown][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model kind {model.kind}")
    out = Tokenizer(core)
    steps: list = []
    if model.charsmap:
        steps.append(normalizers.Precompiled(model.charsmap))
    if model.squeeze:
        # Spaces alone: sentencepiece keeps other white space that the charsmap has not made a space.
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape:
        steps.append(normalizers.Replace(" ", MARK))
    out.normalizer = normalizers.Sequence(steps)
    if cuts_at_marks(model):
        # No piece has a mark after another character: what lies between marks is encoded by itself, which is the same and far faster.
        out.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []
    out.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return out, model


def cuts_at_marks(model: ModelFile) -> bool:
    return model.escape and not any(MARK in p.lstrip(MARK) for p, _, kind in model.pieces if kind in (NORMAL, USER, UNUSED))


def cuts_at_feeds(model: ModelFile) -> bool:
    """Whether a text may also be cut before line feeds: each is a byte's piece, which no merge takes in, and the text is encoded as it is."""
    plain = model.kind == BPE and model.byte_fallback and model.dummy_prefix and not model.charsmap and not model.squeeze
    return plain and cuts_at_marks(model) and ("<0x0A>", BYTE) in {(p, kind) for p, _, kind in model.pieces} and not any("\n" in p for p, _, _ in model.pieces)


class PieceModel:
    """Encodes and decodes batches on the library's threads.

    Where the model lets texts be cut before spaces and line feeds, each distinct piece is
    encoded once. A text that begins with a space, or has spaces in a row or the mark
    itself, is encoded whole.
    """

    _ODD = f"\\A |  |{MARK}"

    def __init__(self, path: str, threads: bool = True) -> None:
        self.threads = threads
        os.environ.setdefault("RAYON_NUM_THREADS", "2")
        self.tokenizer, self.model = build(path)
        self._bare = None
        if cuts_at_feeds(self.model):
            from tokenizers import Tokenizer

            self._bare = Tokenizer(self.tokenizer.model)
        self._cache = PieceCache(self._encode_pieces)
        values = [int(p[3:5], 16) if _BYTE_PIECE.fullmatch(p) else None for p, _, _ in self.model.pieces]
        self._spelled = [p.replace(MARK, " ") if b is None else chr(b) for (p, _, _), b in zip(self.model.pieces, values)]
        self._bytes = np.array([b is not None and b >= 128 for b in values])
        self._control = {i for i, p in enumerate(self.model.pieces) if p[2] == CONTROL}

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Of pieces that begin with a line feed, or stand for themselves after a mark."""
        shown = [p if p[:1] == "\n" else MARK + p for p in pieces]
        return [np.array(e.ids, "<u4").tobytes() for e in self._bare.encode_batch_fast(shown, add_special_tokens=False)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit bytes; the empty text has none."""
        library_threads(self.threads)
        out = [b""] * len(texts)
        column = pa.array(texts, pa.large_string())
        full = pc.greater(pc.binary_length(column), 0)
        odd = pc.match_substring_regex(column, self._ODD) if self._bare else full
        whole = np.flatnonzero(pc.and_(full, odd)).tolist()
        for lo in range(0, len(whole), 128):
            for i, ids in zip(whole[lo : lo + 128], self._encode_whole([texts[i] for i in whole[lo : lo + 128]])):
                out[i] = ids
        at = np.flatnonzero(pc.and_not(full, odd))
        if not len(at):
            return out
        lists = pc.split_pattern(pc.replace_substring(column.take(pa.array(at)), "\n", " \n"), " ")
        pieces = lists.flatten().dictionary_encode()
        joined = pa.array(self._cache.values(pieces.dictionary.to_pylist()), pa.large_binary()).take(pieces.indices)
        ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1)[lists.offsets.to_numpy()].tolist()
        data = joined.buffers()[2]
        for i, start, end in zip(at.tolist(), ends, ends[1:]):
            out[i] = data[start:end].to_pybytes()
        return out

    def decode_batch(self, ids: list[bytes]) -> list[str]:
        """The texts of ids: pieces joined; where some stand for bytes that are no text by themselves, the library puts these together."""
        out, at = [""] * len(ids), []
        lists = [np.frombuffer(x, "<u4") for x in ids]
        for i, x in enumerate(lists):
            if self._bytes[x].any():
                at.append(i)
            else:
                text = "".join([self._spelled[n] for n in x.tolist()])
                out[i] = text[1:] if self.model.dummy_prefix and text[:1] == " " else text
        for i, text in zip(at, self.tokenizer.decode_batch([lists[i].tolist() for i in at], skip_special_tokens=False)):
            out[i] = text
        return out


@functools.lru_cache(maxsize=2)
def piece_model(path: str) -> PieceModel:
    return PieceModel(path)


def _encode(path: str, check: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("pieces", piece_model.cache_clear)
        model = piece_model(path)
        import sentencepiece

        other = sentencepiece.SentencePieceProcessor(model_file=path)
        for doc_ids, texts in rows(batches, "doc_id", "text"):
            for lo in range(0, len(texts), 512):
                part, names = texts[lo : lo + 512], doc_ids[lo : lo + 512]
                ids = model.encode_batch(part)
                back = model.decode_batch(ids)
                same = [np.array(other.encode(t, num_threads=1), "<u4").tobytes() == x for t, x in zip(part, ids)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                        pa.array([b == t for b, t in zip(back, part)], pa.bool_()),
                        pa.array(same, pa.bool_()),
                        pa.array(ids if check else [None] * len(ids), pa.binary()),
                    ],
                    ["doc_id", "n_tokens", "ids_crc32", "round_trip", "parity", "ids"],
                )

    return run


def piece_ids(docs: DataFrame, path: str, keep_ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip, parity, ids) of each row of ``docs(doc_id, text, ...)``.

    ``round_trip`` is whether decoding the ids gives the text back; ``parity`` whether the
    sentencepiece library gives the same ids. Both are asked of every row. Null and empty texts have no ids. No begin, end or added special
    tokens; no truncation or padding. Rows that repeat are encoded each; an empty table
    gives no rows.
    """
    bound_batches(docs.sparkSession)
    return whole_texts(docs).mapInArrow(_encode(path, keep_ids), "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean, parity boolean, ids binary")


def parity(path: str, texts: list[str]) -> list[str]:
    """The texts whose ids or decoded text differ from the sentencepiece library's."""
    import sentencepiece

    model, other = piece_model(path), sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [np.frombuffer(x, "<u4").tolist() for x in model.encode_batch(texts)]
    wanted = other.encode(texts)
    return [t for t, a, b, d in zip(texts, ids, wanted, model.decode_batch([np.array(x, "<u4").tobytes() for x in ids])) if a != b or d != other.decode(b)]
