"""Exact, bounded caches over public tokenizers: a text is cut where no token can cross, and each distinct piece is encoded once."""

from __future__ import annotations

import codecs
import functools
import hashlib
import itertools
import json
import operator
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import hold_cache, library_threads

#: Distinct pieces in each of the two generations that a Python worker keeps.
CACHE_PIECES = 450_000
#: Longer pieces are encoded each time and never kept.
CACHE_CHARS = 24


def file_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


#: What the byte-level alphabet writes for each byte: itself where that is a visible Latin-1 character, else the next character from U+0100 on; line feeds are kept apart.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LEVEL = "".join("\n" if b == 10 else chr(b) if b in _SHOWN else chr(256 + sum(x not in _SHOWN for x in range(b))) for b in range(256))


class PieceCache:
    """Pieces of text to values; what a batch of texts lacks is encoded at once.

    Two generations bound the memory: when the young one is full it becomes the old
    one, and pieces of the old one that are met again move up.
    """

    def __init__(self, encode_many, pieces: int | None = None) -> None:
        self._encode_many = encode_many
        self._pieces = pieces or CACHE_PIECES
        self._young: dict[str, object] = {}
        self._old: dict[str, object] = {}

    def values(self, pieces: list[str]) -> list:
        """The values of pieces that are all different."""
        young, old = self._young, self._old
        found = list(map(young.get, pieces))
        new = []
        for i in itertools.compress(range(len(found)), map(operator.is_, found, itertools.repeat(None))):
            piece = pieces[i]
            value = old.get(piece)
            if value is None:
                new.append(i)
            else:
                found[i] = young[piece] = value
        if new:
            for i, value in zip(new, self._encode_many([pieces[i] for i in new])):
                found[i] = value
                piece = pieces[i]
                if len(piece) <= CACHE_CHARS:
                    young[piece] = value
        if len(young) > self._pieces:
            self._old, self._young = young, {}
        return found

    def lookup(self, texts: list[list[str]]) -> list[list]:
        young = self._young
        found = [list(map(young.get, pieces)) for pieces in texts]
        holes = [list(itertools.compress(range(len(values)), map(operator.is_, values, itertools.repeat(None)))) for values in found]
        missing = {pieces[i] for pieces, at in zip(texts, holes) for i in at}
        if missing:
            moved = missing.intersection(self._old)
            young.update(zip(moved, map(self._old.__getitem__, moved)))
            new = list(missing.difference(moved))
            young.update(zip(new, self._encode_many(new)))
            for pieces, values, at in zip(texts, found, holes):
                for i in at:
                    values[i] = young[pieces[i]]
            for piece in new:
                if len(piece) > CACHE_CHARS:
                    del young[piece]
        if len(young) > self._pieces:
            self._old, self._young = young, {}
        return found


def _chunks(items: list[str], chars: int = 1 << 16) -> Iterator[list[str]]:
    chunk, size = [], 0
    for item in items:
        chunk.append(item)
        size += len(item) + 1
        if size > chars:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _slices(ids: np.ndarray, ends: np.ndarray, n: int, gap: int) -> list[bytes]:
    """The bytes of ``n`` runs of ids that end at ``ends``, ``gap`` ids apart."""
    if len(ends) != n or (n and int(ends[-1]) != len(ids)):
        raise ValueError("pieces can't be told apart")
    data, out, at = ids.tobytes(), [], 0
    for end in (4 * ends).tolist():
        out.append(data[at:end])
        at = end + 4 * gap
    return out


class IdEncoder:
    """Ids of whole texts by a file of the tokenizers library, as little-endian unsigned 32-bit bytes.

    The library gives the ids; this class only decides which parts of a text may be
    encoded apart. A text is cut at single spaces and line feeds between other
    characters, where neither pre-tokenizer joins the sides: the byte-level one keeps a
    space with what follows, the word-level one drops white space. A text with other
    white space, white space in a row, or a string of an added token is encoded whole.
    Distinct pieces that are one word, or a word and one mark after it, go to the
    library's model as words, past the pre-tokenizer that would find just these; others go
    through all of it, joined by a separator that is a token of its own.
    """

    #: White space in a row or at an end, white space but spaces and line feeds, and marks that may be taken as such or that this class uses.
    _ODD = "\\A[ \n]|[ \n][ \n]|[ \n]\\z|[\\x00\\x01\t\x0b-\r\x1b-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u3000\ufeff]"
    #: Letters that every version of Unicode and both pre-tokenizers take as such, and that have no decomposed neighbour.
    _WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
    _END_MARKS = frozenset(".,;:!?")

    def __init__(self, path: str, cache_pieces: int | None = None) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.tokenizer.get_vocab_size()
        added = [x["content"] for x in spec.get("added_tokens", [])]
        self._odd = "|".join([self._ODD, *("(?i:" + re.sub(r"([!-/:-@\[-`{-~])", r"\\\1", x) + ")" for x in added)])
        kinds = str(spec.get("pre_tokenizer"))
        self._keeps_spaces = "Split" not in kinds and "'type': 'ByteLevel'" in kinds and spec.get("normalizer") is None
        self._drops_spaces = "'behavior': 'Removed'" in kinds and (spec.get("normalizer") or {}).get("type") == "Sequence"
        self._mark = "\n" if self._keeps_spaces else " \x01 "
        mark = self.tokenizer.encode(self._mark, add_special_tokens=False).ids
        self._mark_id = mark[0] if len(mark) == 1 else None
        self._cuts = (self._keeps_spaces or self._drops_spaces) and self._mark_id is not None
        self._feed = np.array(mark, "<u4").tobytes()
        # Words apart: the model alone, for words whose bytes stand as the byte-level alphabet writes them; a word's edge shows in its tokens.
        self._model = self._edges = None
        if self._cuts and spec["model"]["type"] == "BPE":
            self._model = Tokenizer.from_str(json.dumps({**spec, "normalizer": None, "pre_tokenizer": None, "added_tokens": [], "post_processor": None}))
            self._edges = np.zeros(self.size, bool)
            suffix = spec["model"].get("end_of_word_suffix")
            for token, i in spec["model"]["vocab"].items():
                self._edges[i] = token.startswith("\u0120") if self._keeps_spaces else bool(suffix) and token.endswith(suffix)
            if not self._edges.any():
                self._model = None
        self._cache = PieceCache(self._encode_pieces, cache_pieces)
        self._marks = {m: self._encode_whole([m])[0] for m in self._END_MARKS}

    def _encode_whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, pieces: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for chunk in _chunks(pieces):
            ids = np.array(self.tokenizer.encode_batch_fast([self._mark.join(chunk)], add_special_tokens=False)[0].ids, "<u4")
            out += _slices(ids, np.append(np.flatnonzero(ids == self._mark_id), len(ids)), len(chunk), 1)
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Of plain words: after a space where spaces are kept, in lower case where they are dropped."""
        out: list[bytes] = []
        for chunk in _chunks(words):
            shown = " " + "\n ".join(chunk) if self._keeps_spaces else "\n".join(chunk).lower()
            written = codecs.charmap_decode(shown.encode(), "strict", _BYTE_LEVEL)[0].split("\n")
            ids = np.array(self._model.encode_batch_fast([written], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
            edges = np.flatnonzero(self._edges[ids])
            ends = np.append(edges[1:], len(ids)) if self._keeps_spaces else edges + 1
            out += _slices(ids, ends, len(chunk), 0)
        return out

    def _encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Pieces as ``_cut`` makes them: a byte-level one stands for itself after a space, or begins with a line feed or, first in its text, with a null."""
        plain = list(map(bool, map(self._WORD.fullmatch, pieces))) if self._model else [False] * len(pieces)
        out: list = [b""] * len(pieces)
        at = list(itertools.compress(range(len(pieces)), plain))
        for i, ids in zip(at, self._encode_words([pieces[i] for i in at])):
            out[i] = ids
        rest = [i for i, x in enumerate(plain) if not x]
        if not self._keeps_spaces:
            groups = [(rest, [pieces[i] for i in rest], b"")]
        else:
            spaced, fed, first = ([i for i in rest if low <= pieces[i][0] <= high] for low, high in (("\x0b", "\U0010ffff"), ("\n", "\n"), ("\x00", "\x00")))
            groups = [(spaced, [" " + pieces[i] for i in spaced], b""), (fed, [pieces[i][1:] for i in fed], self._feed), (first, [pieces[i][1:] for i in first], b"")]
        for places, texts, before in groups:
            for i, ids in zip(places, self._encode_joined(texts)):
                out[i] = before + ids
        return out

    def _values(self, pieces: list[str]) -> list[bytes]:
        """The ids of different pieces; a plain word and one mark after it are looked up apart, as both pre-tokenizers take them."""
        if not self._model:
            return self._cache.values(pieces)
        tails = [p[-1] if p[-1:] in self._END_MARKS and self._WORD.fullmatch(p, 0, len(p) - 1) else "" for p in pieces]
        at = list(itertools.compress(range(len(pieces)), tails))
        keys = dict.fromkeys(pieces)
        for i in at:
            del keys[pieces[i]]
        keys.update(dict.fromkeys([pieces[i][:-1] for i in at]))
        known = dict(zip(keys, self._cache.values(list(keys))))
        for i in at:
            piece = pieces[i]
            known[piece] = known[piece[:-1]] + self._marks[tails[i]]
        return list(map(known.__getitem__, pieces))

    def _cut(self, texts: pa.Array) -> pa.Array:
        """Lists of the pieces of texts that may be cut."""
        if not self._keeps_spaces:
            return pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        first, empty = pa.scalar("\x00", pa.large_string()), pa.scalar("", pa.large_string())
        return pc.split_pattern(pc.replace_substring(pc.binary_join_element_wise(first, texts, empty), "\n", " \n"), " ")

    def encode_batch(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text; pieces are told apart, looked up and joined by Arrow, so that Python sees the distinct ones alone."""
        library_threads(False)
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        out = [b""] * len(column)
        full = pc.greater(pc.binary_length(column), 0)
        odd = pc.match_substring_regex(column, self._odd) if self._cuts else full
        for batch_at in range(0, len(whole := np.flatnonzero(pc.and_(full, odd))), 16):
            at = whole[batch_at : batch_at + 16]
            for i, ids in zip(at.tolist(), self._encode_whole(column.take(pa.array(at)).to_pylist())):
                out[i] = ids
        at = np.flatnonzero(pc.and_not(full, odd))
        if not len(at):
            return out
        lists = self._cut(column.take(pa.array(at)))
        pieces = lists.flatten().dictionary_encode()
        values = pa.array(self._values(pieces.dictionary.to_pylist()), pa.large_binary())
        joined = values.take(pieces.indices)
        ends = np.frombuffer(joined.buffers()[1], "<i8", len(joined) + 1)[lists.offsets.to_numpy()].tolist()
        data = joined.buffers()[2]
        for i, start, end in zip(at.tolist(), ends, ends[1:]):
            out[i] = data[start:end].to_pybytes()
        return out


@functools.lru_cache(maxsize=1)
def _id_encoder(path: str, cache_pieces: int | None) -> IdEncoder:
    return IdEncoder(path, cache_pieces)


def id_encoder(path: str, cache_pieces: int | None = None) -> IdEncoder:
    """The worker's encoder for a file; only one is kept, with ``cache_pieces`` in each generation of its cache."""
    hold_cache("ids", _id_encoder.cache_clear)
    return _id_encoder(path, cache_pieces)


class PieceCounter:
    """Token counts of whole texts by a sentencepiece model file.

    With the identity normaliser a space becomes the space mark, and a text may be cut
    before a mark that follows another character, unless a piece of the vocabulary
    has such a mark inside; the same holds for line feeds, which no piece may contain.
    The vocabulary is looked through once; a model for which this does not hold, or a
    text with spaces in a row, is encoded whole.
    """

    MARK = "\u2581"
    _ODD = re.compile("\\A\\n|  |[\x00\u2581]|(?m:^ | $)")

    def __init__(self, path: str) -> None:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = pb.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        plain = spec.normalizer_spec
        inner = re.compile(f"[^{self.MARK}]{self.MARK}")
        odd = [p.piece for p in spec.pieces if p.type == 4 or p.type in (1, 5) and (inner.search(p.piece) or "\n" in p.piece or " " in p.piece)]
        self._cuts = not odd and plain.name == "identity" and not plain.precompiled_charsmap and not plain.remove_extra_whitespaces and plain.add_dummy_prefix and plain.escape_whitespaces and spec.trainer_spec.byte_fallback and not spec.trainer_spec.treat_whitespace_as_suffix
        self._starts = np.array([p.piece.startswith(self.MARK) for p in spec.pieces])
        feed = self.model.encode("\n")
        self._cuts = self._cuts and len(feed) == 2
        self._feed = feed[-1]
        self._words = PieceCache(self._count_words)
        self._bare = PieceCache(self._count_bare)

    def _count_words(self, words: list[str]) -> list[int]:
        out: list[int] = []
        for chunk in _chunks(words):
            ids = np.array(self.model.encode(" ".join(chunk), num_threads=1))
            at = np.append(np.flatnonzero(self._starts[ids]), len(ids))
            if len(at) != len(chunk) + 1:
                raise ValueError("a word holds the space mark")
            out += np.diff(at).tolist()
        return out

    def _count_bare(self, words: list[str]) -> list[int]:
        """Of words that follow a line feed and so have no space mark."""
        out: list[int] = []
        for chunk in _chunks(words):
            ids = np.array(self.model.encode("\n" + "\n".join(chunk), num_threads=1))
            at = np.append(np.flatnonzero(ids == self._feed), len(ids))
            if len(at) != len(chunk) + 1:
                raise ValueError("a word holds a line feed")
            out += (np.diff(at) - 1).tolist()
        return out

    def count_batch(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        cut, words, bare = [], [], []
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self._cuts or self._ODD.search(text):
                out[i] = len(self.model.encode(text, num_threads=1))
                continue
            head, *lines = text.split("\n")
            firsts, rest = [], head.split(" ")
            for line in lines:
                first, *tail = line.split(" ")
                firsts.append(first)
                rest += tail
            out[i] = len(lines)
            cut.append(i)
            words.append(rest)
            bare.append(firsts)
        for i, x, y in zip(cut, self._words.lookup(words), self._bare.lookup(bare)):
            out[i] += sum(x) + sum(y)
        return out


@functools.lru_cache(maxsize=1)
def _piece_counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def piece_counter(path: str) -> PieceCounter:
    """The worker's counter for a model; only one is kept."""
    hold_cache("counts", _piece_counter.cache_clear)
    return _piece_counter(path)


def library_counter(path: str):
    """A function from texts to token counts, by the library that the file belongs to."""
    if path.endswith(".model"):
        return piece_counter(path).count_batch
    encoder = id_encoder(path)
    return lambda texts: [len(ids) // 4 for ids in encoder.encode_batch(texts)]
