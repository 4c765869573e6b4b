"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hold_cache, rows, whole_texts

#: Bounds of the labelled sample that the model is fitted on: rows of label 1, other rows, and bytes of all their texts.
SAMPLE_POSITIVES, SAMPLE_OTHERS, SAMPLE_BYTES = 1200, 1800, 12 << 20
BUCKETS, DIMENSIONS = 1 << 18, 8
SHORTEST, LONGEST = 3, 6
#: A bucket whose share among documents of label 1 is so many standard deviations off is trusted by half.
EVEN_SIGMAS = 5.0
#: Words whose n-grams are summed at a time.
CHUNK_WORDS = 1 << 15
STEPS = 100
THRESHOLD = 0.3
EDGES = ".,;:!?\"'()[]{}<>«»“”…|"


_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def buckets(some: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of each character n-gram of some words, their ends marked, and of the words themselves."""
    marked = [f"<{w.strip(EDGES)}>" for w in some]
    lengths = np.fromiter(map(len, marked), np.int64, len(marked))
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    word = np.repeat(np.arange(len(marked), dtype=np.int32), lengths)
    left = np.cumsum(lengths)[word] - np.arange(len(codes))
    # A whole word of SHORTEST to LONGEST characters is one of its own n-grams.
    other = np.flatnonzero((lengths < SHORTEST) | (lengths > LONGEST))
    whole = np.array([zlib.crc32(marked[i].encode("utf-8", "surrogatepass")) for i in other.tolist()], np.uint64) * _ODD
    at, hashes, rolling = [other.astype(np.int32)], [whole], np.zeros(len(codes), np.uint64)
    for n in range(1, min(LONGEST, len(codes)) + 1):
        rolling = rolling[: len(codes) - n + 1] * _ODD + codes[n - 1 :]
        if n >= SHORTEST:
            inside = left[: len(rolling)] >= n
            at.append(word[: len(rolling)][inside])
            hashes.append(rolling[inside])
    mixed = np.concatenate(hashes)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.concatenate(at), ((mixed ^ (mixed >> np.uint64(29))) % np.uint64(BUCKETS)).astype(np.int32)


def words(text: str) -> list[str]:
    return text.lower().split()


#: Word scores that a Python worker keeps, for all tasks that have one model.
CACHE_WORDS = 150_000
#: Characters of texts whose new words are looked up together.
GROUP_CHARACTERS = 1 << 20
_KNOWN: dict[int, dict[str, float]] = {}


@dataclass
class Model:
    """``weights`` has, for each bucket, its embedding times the difference of the softmax's two rows, or is empty; ``bias`` likewise."""

    weights: np.ndarray
    bias: float

    def __post_init__(self) -> None:
        self.name = zlib.crc32(self.weights.tobytes())

    def words(self, some: list[str]) -> list[float]:
        """Each word's mean over its n-grams, itself among them."""
        at, held = buckets(some)
        return (np.bincount(at, self.weights[held], len(some)) / np.bincount(at, minlength=len(some))).tolist()

    def scores(self, texts: list[str]) -> list[float]:
        """Probability of label 1 of each text; a text without words gets what the bias says."""
        if not len(self.weights):
            return [_softmax(self.bias)] * len(texts)
        if self.name not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[self.name] = {}
        known, out, at = _KNOWN[self.name], [], 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < GROUP_CHARACTERS:
                group.append(words(texts[at]))
                size += len(texts[at])
                at += 1
            if len(known) > CACHE_WORDS:
                known.clear()
            new = list({w for found in group for w in found if w not in known})
            for i in range(0, len(new), CHUNK_WORDS):
                known.update(zip(some := new[i : i + CHUNK_WORDS], self.words(some)))
            out += [_softmax(sum(map(known.__getitem__, found)) / max(len(found), 1) + self.bias) for found in group]
        return out

    def score(self, text: str) -> float:
        return self.scores([text])[0]


def _softmax(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -40, 40))))


def _trust(doc_at: np.ndarray, word_at: np.ndarray, gram_at: np.ndarray, starts: np.ndarray, y: np.ndarray, n_buckets: int) -> np.ndarray:
    """How freely each bucket's embedding may move, between 0 and 1; none is left out.

    The number of documents of label 1 that hold a bucket is held against its mean and
    deviation under drawing without replacement: z deviations off give z^4 / (z^4 + EVEN_SIGMAS^4).
    Averages over few words of a short document would otherwise carry the noise of buckets
    that tell nothing.
    """
    number, positive = np.zeros(n_buckets), np.zeros(n_buckets)
    order = np.argsort(doc_at, kind="stable")
    bounds = np.searchsorted(doc_at[order], np.arange(len(y) + 1))
    for d, (lo, hi) in enumerate(zip(bounds[:-1], bounds[1:])):
        held = [gram_at[starts[w] : starts[w + 1]] for w in word_at[order[lo:hi]].tolist()]
        if held:
            held = np.unique(np.concatenate(held))
            number[held] += 1
            positive[held] += y[d]
    n, ones = len(y), y.sum()
    share = number / n
    deviation = np.sqrt(ones * share * (1 - share) * (n - ones) / max(n - 1, 1))
    z4 = ((positive - ones * share) / np.maximum(deviation, 0.25)) ** 4
    return z4 / (z4 + EVEN_SIGMAS**4)


class Bags:
    """Documents as bags of words, words as bags of n-grams, and the gradients of a softmax over their mean embeddings."""

    def __init__(self, texts: list[str]) -> None:
        index: dict[str, int] = {}
        doc_at, word_at, weight = array("i"), array("i"), array("d")
        for d, text in enumerate(texts):
            counts = Counter(words(text))
            total = sum(counts.values())
            for w, n in counts.items():
                doc_at.append(d)
                word_at.append(index.setdefault(w, len(index)))
                weight.append(n / total)
        self.doc_at, self.word_at, self.weight, self.n_words, self.n_docs = np.array(doc_at), np.array(word_at), np.array(weight), len(index), len(texts)
        parts, sizes, listed = [np.empty(0, np.int32)], [np.empty(0, np.int64)], list(index)
        for i in range(0, len(listed), CHUNK_WORDS):
            at, held = buckets(listed[i : i + CHUNK_WORDS])
            parts.append(held[np.argsort(at, kind="stable")])
            sizes.append(np.bincount(at, minlength=len(listed[i : i + CHUNK_WORDS])))
        self.gram_at, self.sizes = np.concatenate(parts), np.concatenate(sizes)
        del parts
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        # Buckets in use, numbered from 0 on in place: no copy of the n-grams is sorted.
        self.used = np.flatnonzero(np.bincount(self.gram_at, minlength=BUCKETS))
        place = np.zeros(BUCKETS, np.int32)
        place[self.used] = np.arange(len(self.used), dtype=np.int32)
        np.take(place, self.gram_at, out=self.gram_at)
        self.chunks = [(i, min(i + CHUNK_WORDS, len(index))) for i in range(0, len(index), CHUNK_WORDS)]

    def by_word(self, value: np.ndarray) -> np.ndarray:
        """Mean of a value of each bucket over each word's n-grams."""
        return np.concatenate([np.add.reduceat(value[self.gram_at[self.starts[i] : self.starts[j]]], self.starts[i:j] - self.starts[i]) for i, j in self.chunks]) / self.sizes

    def by_gram(self, value: np.ndarray) -> np.ndarray:
        """Sum of a value of each word, shared among its n-grams, over the words that hold each bucket."""
        share = value / self.sizes
        return sum(np.bincount(self.gram_at[self.starts[i] : self.starts[j]], np.repeat(share[i:j], self.sizes[i:j]), len(self.used)) for i, j in self.chunks)

    def trust(self, y: np.ndarray) -> np.ndarray:
        """:func:`_trust` of the buckets in use."""
        return _trust(self.doc_at, self.word_at, self.gram_at, self.starts, y, len(self.used))

    def gradients(self, trust: np.ndarray, vectors: np.ndarray, softmax: np.ndarray, bias: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Mean cross-entropy, and its gradients by the embeddings, the softmax's rows and the biases.

        Every gradient of an embedding is a number times the difference of the softmax's
        rows, so two sums over (document, word) and two over (word, n-gram) give all.
        """
        line = softmax[1] - softmax[0]
        word = self.by_word(trust * (vectors @ line))
        logit = np.bincount(self.doc_at, self.weight * word[self.word_at], len(y)) + bias[1] - bias[0]
        loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
        error = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - y) / len(y)
        on_gram = trust * self.by_gram(np.bincount(self.word_at, self.weight * error[self.doc_at], self.n_words))
        pull = vectors.T @ on_gram
        return loss, on_gram[:, None] * line[None, :], np.stack([-pull, pull]), np.array([-error.sum(), error.sum()])


def train(texts: list[str], labels: list[int], seed: int = 7) -> Model:
    """Fit embeddings and softmax together by full-batch descent with steps of falling length."""
    y = np.array(labels, float)
    share = float(np.clip(y.mean() if len(y) else 0.01, 0.01, 0.99))
    bags = Bags(texts)
    if not bags.n_words or y.min() == y.max():
        return Model(np.empty(0, np.float32), float(np.log(share / (1 - share))))
    trust, rng = bags.trust(y), np.random.default_rng(seed)
    values = [rng.normal(0, 1e-3, (len(bags.used), DIMENSIONS)), rng.normal(0, 0.5, (2, DIMENSIONS)), np.array([0.0, np.log(share / (1 - share))])]
    moved = [np.zeros_like(v) for v in values]
    for t in range(STEPS):
        _, *grads = bags.gradients(trust, *values, y)
        grads[2] = grads[2] * len(y) / 20
        for k, rate in enumerate((2.0, 0.5, 0.1)):
            # One scale for a whole array: what is rare moves little, as its gradient is small.
            moved[k] = 0.8 * moved[k] + 0.2 * grads[k] / max(float(np.abs(grads[k]).max()), 1e-9)
            values[k] -= (1 - t / STEPS) * rate * moved[k]
    vectors, softmax, bias = values
    weights = np.zeros(BUCKETS, np.float32)
    weights[bags.used] = trust * (vectors @ (softmax[1] - softmax[0]))
    return Model(weights, float(bias[1] - bias[0]))


def held_out(doc_id) -> F.Column:
    """Rows whose labels are never learnt."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, positives: int = SAMPLE_POSITIVES, others: int = SAMPLE_OTHERS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Train on a bounded sample of the labelled documents, taken in the order of a hash of their ids.

    Label 1 is rare, so each label has a bound of its own, and the model's bias is then
    moved to the share of label 1 among all labels that may be learnt. Each label has a
    part of ``sample_bytes`` like its part of the rows, and what the other leaves of its
    own; where its texts take more, the longest are left out. Equal texts are learnt from
    once.
    """
    bound_batches(docs.sparkSession)
    marked = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    count = marked.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("ones")).first()
    some = marked.where("toxic = 1").orderBy(*order).limit(positives).union(marked.where("toxic = 0").orderBy(*order).limit(others))
    texts = whole_texts(docs).join(F.broadcast(some), "doc_id").withColumn("size", F.octet_length("text").cast("long"))
    label = Window.partitionBy("toxic")
    others_take = F.sum("size").over(Window.partitionBy()) - F.sum("size").over(label)
    part = F.when(F.col("toxic") == 1, sample_bytes * positives // (positives + others)).otherwise(sample_bytes * others // (positives + others))
    texts = texts.withColumn("room", F.greatest(part, F.lit(sample_bytes) - others_take)).withColumn("upto", F.sum("size").over(label.orderBy("size", *order, "text")))
    texts = texts.where("upto <= room").orderBy(*order, "text").select("text", "toxic")
    found = texts.toArrow()
    # Copies of one document say no more than one: equal texts are learnt from once, as toxic where any of them is.
    unique: dict[str, int] = {}
    for text, toxic in zip(found.column("text").to_pylist(), found.column("toxic").to_pylist()):
        unique[text] = max(toxic, unique.get(text, 0))
    model = train(list(unique), learnt := list(unique.values()))
    odds = lambda ones, n: np.log((ones + 0.5) / (n - ones + 0.5))
    if 0 < sum(learnt) < len(learnt):
        model.bias += float(odds(count["ones"], count["n"]) - odds(sum(learnt), len(learnt)))
    return model


def scorer(model: Model, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("toxicity", _KNOWN.clear)
        for ids, held, texts in rows(batches, "doc_id", "held_out", "text"):
            scores = model.scores(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"]
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text, ...)``.

    Only the text is scored, the whole of it; null counts as empty, and a text without
    words gets the bias's score. Rows that repeat score alike. Without labels of both
    kinds the model is the share of label 1 among them, or 0.01 where there are none.
    A null doc_id is not held out.
    """
    model = fit(docs, labels)
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return docs.mapInArrow(scorer(model, threshold), "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns, in place."""
    model = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("toxicity", _KNOWN.clear)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([s < threshold for s in model.scores([t or "" for t in texts])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
