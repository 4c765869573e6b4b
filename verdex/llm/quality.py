"""Quality by weak supervision: rules vote or abstain, and expectation-maximisation weighs them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import bound_batches, hold_cache, rows, staged, whole_texts

FEATURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_stop", "n_distinct"]
SYMBOLS = "#*$%&|<>"
#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    b"the of and to in is that it for with as was on are by this be from or an at "
    b"de la le les des et un une du que dans pour qui sur par est pas au "
    b"der die das und von den mit zu auf ist nicht ein eine dem sich "
    b"el los las en y a por con para del se no su al".split()
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
ROUNDS = 50
_UPPER = re.compile(r"[A-Z\u00C0-\u00DE]")


def text_features(text: str) -> tuple[int, ...]:
    """Counts of one text in the order of FEATURES.

    Words are ``[^\\x20\\x09-\\x0D]+``; word_chars counts their code points; n_repeat_words
    counts the words that lie in a window of three found twice or more.
    """
    found = text.encode("utf-8", "surrogatepass").split()
    n = len(found)
    blanks = sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(" \t\x0b\x0c\r")]
    upper = len(_UPPER.findall(text))
    repeated = 0
    if n > 3:
        words = np.fromiter(map(hash, found), np.int64, n).view(np.uint64)
        windows = words[:-2] * np.uint64(0x9E3779B97F4A7C15) + words[1:-1]
        windows = (windows ^ (windows >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + words[2:]
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        if same.any():
            twice = np.zeros(n, bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            inside = twice.copy()
            inside[1:] |= twice[:-1]
            inside[2:] |= twice[:-2]
            repeated = int(inside.sum())
    lowered = [w.lower() for w in found]
    stop = sum(map(STOP_WORDS.__contains__, lowered))
    return n, len(text) - blanks, symbols, len(lines) - len(set(lines)), repeated, len(lines), upper, stop, len(set(lowered))


@dataclass(frozen=True)
class Rule:
    """Votes 1 (good), -1 (bad) or 0 (abstains) by SQL over the features."""

    name: str
    bad: str
    good: str


RULES = (
    Rule("length", "n_words < 50", "n_words >= 80"),
    Rule("repetition", "10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
    Rule("symbols", "10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    Rule("lines", "10 * n_dup_lines > 3 * n_lines", "n_dup_lines = 0"),
    Rule("word_length", "word_chars > 12 * n_words or 2 * word_chars < 5 * n_words", "word_chars <= 9 * n_words and word_chars >= 3 * n_words"),
    Rule("capitals", "10 * n_upper > 4 * word_chars", "10 * n_upper <= word_chars"),
    Rule("function_words", "100 * n_stop < 2 * n_words", "100 * n_stop >= 8 * n_words"),
    Rule("variety", "10 * n_distinct < 2 * n_words and n_words < 3000", "10 * n_distinct >= 4 * n_words"),
)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_cache("quality", lambda: None)
    for ids, texts in rows(batches, "doc_id", "text"):
        found = np.array([text_features(t) for t in texts], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(found[:, i]) for i in range(len(FEATURES))]], ["doc_id", *FEATURES])


def document_features(docs: DataFrame) -> DataFrame:
    """doc_id and FEATURES of every whole text; null counts as empty."""
    bound_batches(docs.sparkSession)
    return whole_texts(docs).mapInArrow(_features, "doc_id long, " + ", ".join(f"{f} long" for f in FEATURES))


def with_votes(features: DataFrame, prefix: str = "") -> DataFrame:
    """Adds ``pattern``, the rules' votes as one number in base 3, digit vote + 1 each, and ``base_failed``; both and FEATURES with ``prefix`` before their names."""
    named = lambda sql: re.sub(r"\b(n_\w+|word_chars)\b", rf"`{prefix}\1`", sql)
    pattern = " + ".join(f"(case when {named(r.bad)} then 0 when {named(r.good)} then 2 else 1 end) * {3**i}" for i, r in enumerate(RULES))
    failed = named(f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words")
    return features.withColumn(f"{prefix}pattern", F.expr(pattern).cast("int")).withColumn(f"{prefix}base_failed", F.expr(failed))


@dataclass
class VoteModel:
    """Posterior probability of good quality for each pattern of votes, and what it came from."""

    prior: float
    right_if_good: list[float]
    right_if_bad: list[float]
    posterior: dict[int, float] = field(default_factory=dict)


def estimate(counts: dict[int, int], rounds: int = ROUNDS) -> VoteModel:
    """Expectation-maximisation over patterns and how often each occurs.

    Each rule that votes is right with one chance on good and another on bad documents,
    independently; abstaining says nothing. Chances start from the votes' majority, a bad
    vote weighing more as rules say bad for cause; they are smoothed by one case each. A
    rule may be of no use on a corpus, but never turns round, so that the classes can't
    change names. Without documents every chance is that of the smoothing.
    """
    patterns = sorted(counts)
    weight = np.array([counts[p] for p in patterns], float)
    votes = np.array([[p // 3**i % 3 - 1 for i in range(len(RULES))] for p in patterns], int).reshape(len(patterns), len(RULES))
    good = 1 / (1 + np.exp(-((votes == 1) * 0.5 - (votes == -1) * 1.5).sum(axis=1)))
    prior, if_good, if_bad = 0.5, np.full(len(RULES), 0.5), np.full(len(RULES), 0.5)
    for _ in range(rounds):
        on_good, on_bad = weight * good, weight * (1 - good)
        prior = float(np.clip((on_good.sum() + 1) / (weight.sum() + 2), 0.02, 0.98))
        share = lambda w, v: (w @ (votes == v) + 1) / (w @ (votes != 0) + 2)
        if_good, if_bad = np.clip(share(on_good, 1), 0.0001, 0.9999), np.clip(share(on_bad, -1), 0.0001, 0.9999)
        # A bad vote is never likelier on good documents than on bad ones; at most, it says nothing.
        if_bad = np.maximum(if_bad, 1 - if_good)
        odds = np.log(prior / (1 - prior)) + (votes == 1) @ np.log(if_good / (1 - if_bad)) + (votes == -1) @ np.log((1 - if_good) / if_bad)
        good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return VoteModel(prior, if_good.tolist(), if_bad.tolist(), dict(zip(patterns, good.tolist())))


def fit(voted: DataFrame) -> VoteModel:
    """Count all documents by pattern (at most 3 to the number of rules) and estimate."""
    return estimate({r["pattern"]: r["n"] for r in voted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()})


def quality(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, FEATURES, base_failed, probability and kept for each row of ``docs(doc_id, text, ...)``.

    ``kept`` is false where base_failed, else whether the posterior probability of good
    quality reaches ``threshold``. Null and empty texts have no words and fail the base;
    rows that repeat count and come out each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    voted = staged(with_votes(document_features(docs)), "quality-votes")
    model = fit(voted)
    posterior = spark.createDataFrame(list(model.posterior.items()), "pattern int, probability double")
    return voted.join(F.broadcast(posterior), "pattern").withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= threshold)).drop("pattern")


def _beside(prefix: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("quality", lambda: None)
        for batch in batches:
            if batch.num_rows:
                found = np.array([text_features(t or "") for t in batch.column(batch.schema.get_field_index("text")).to_pylist()], np.int64)
                for i, name in enumerate(FEATURES):
                    batch = batch.append_column(prefix + name, pa.array(found[:, i]))
                yield batch

    return run


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`quality` keeps, with all their columns, in place.

    The second pass needs only the bounded list of good patterns; the same rules vote in it.
    Texts are counted anew rather than written out again beside their counts.
    """
    model = fit(with_votes(document_features(docs)))
    good = [p for p, x in model.posterior.items() if x >= threshold]
    prefix = "_quality_"
    counted = docs.mapInArrow(_beside(prefix), StructType([*docs.schema.fields, *(StructField(prefix + f, LongType()) for f in FEATURES)]))
    voted = with_votes(counted, prefix)
    return voted.where(F.col(f"{prefix}pattern").isin(good) & ~F.col(f"{prefix}base_failed")).select(docs.columns)
