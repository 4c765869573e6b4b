"""Secret scans: patterns propose candidates, a random forest removes the false ones."""

from __future__ import annotations

import base64
import functools
import math
import random
import re
import string
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, hold_cache, rows

#: Public shapes of credentials, tried in this order at each place.
PATTERNS = (
    ("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]{16,}+-----END (?:[A-Z]+ )*PRIVATE KEY-----"),
    ("aws_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("github_token", r"\bgh[pousr]_[A-Za-z0-9]{36,}\b"),
    ("slack_token", r"\bxox[abprs]-[A-Za-z0-9-]{10,}"),
    ("stripe_key", r"\b[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    ("google_key", r"\bAIza[0-9A-Za-z_-]{35}"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    ("assigned", r"(?<![A-Za-z0-9])(?:[Pp]ass(?:word|wd)?|PASSWORD|[Ss]ecret|SECRET|[Tt]oken|TOKEN|[Aa]pi[_-]?[Kk]ey|API[_-]?KEY|[Aa]ccess[_-]?[Kk]ey|ACCESS[_-]?KEY|[Cc]redential)s?[\"']?\s{0,4}[:=]{1,2}\s{0,4}[\"']?(?P<value>[^\s\"'<>,;]{6,})"),
    ("opaque", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{16,}+={0,2}(?![A-Za-z0-9+/_=-])"),
)
_ANY = re.compile("|".join(f"(?P<{name}>{pattern})" for name, pattern in PATTERNS))
KINDS = [name for name, _ in PATTERNS]
#: Words that stand where no secret does, and words beside secrets or beside digests.
DICTIONARY = "example sample changeme change password passwd secret token dummy test testing placeholder your here none null true false default user admin root foo bar baz qwerty letmein redacted hidden value string config environ getenv process undefined xxxx abc".split()
NEAR_SECRETS = frozenset("password passwd secret token key api apikey credential credentials auth login access aws private".split())
NEAR_DIGESTS = frozenset("commit sha sha1 sha256 md5 checksum digest hash etag uuid guid revision integrity blob tree request trace id".split())
CONTEXT = 48
TREES, DEPTH, LEAST_LEAF = 25, 8, 4
#: Bounds of the labelled findings that the forest is fitted on: those made by rule, and the documents, and bytes of their texts, whose candidates are labelled.
MADE_ROWS = 3000
SAMPLE_DOCS, SAMPLE_BYTES = 6000, 12 << 20


@dataclass(frozen=True)
class Candidate:
    start: int
    end: int
    kind: str
    value: str


def candidates(text: str) -> list[Candidate]:
    """Non-overlapping matches over the whole text, the secret's own span each."""
    out = []
    for m in _ANY.finditer(text):
        kind = m.lastgroup if m.lastgroup != "value" else "assigned"
        start, end = m.span("value") if m.group("value") is not None else m.span()
        out.append(Candidate(start, end, kind, text[start:end]))
    return out


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


_WORDLIKE = re.compile(r"[A-Za-z]+")


def features(value: str, kind: str, before: str, after: str, path: str) -> list[float]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of one candidate."""
    n = len(value)
    classes = [_class(c) for c in value]
    counts = Counter(value)
    entropy = -sum(k / n * math.log2(k / n) for k in counts.values())
    switches = sum(a != b for a, b in zip(classes, classes[1:])) / max(1, n - 1)
    steps = sum(abs(ord(b) - ord(a)) <= 1 for a, b in zip(value, value[1:])) / max(1, n - 1)
    lowered = value.lower()
    covered = sum(len(w) for w in DICTIONARY if w in lowered) / n
    vowels = sum(c in "aeiou" for c in lowered) / max(1, sum(c.isalpha() for c in value))
    longest = max((len(x) for x in _WORDLIKE.findall(value)), default=0) / n
    near = [w.lower() for w in _WORDLIKE.findall(before)[-4:] + _WORDLIKE.findall(after)[:2]]
    path = path.lower()
    return [
        float(n), entropy, entropy / math.log2(max(2, n)), switches, steps, covered, vowels, longest,
        classes.count(0) / n, classes.count(1) / n, classes.count(2) / n, classes.count(3) / n,
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(value.count("-") == 4 and n == 36), float(value.count("/") + value.count(".")) / n,
        float(len(counts)) / n, float(KINDS.index(kind)), float(any(w in NEAR_SECRETS for w in near)), float(any(w in NEAR_DIGESTS for w in near)),
        float(any(x in path for x in ("test", "example", "fixture", "doc"))),
    ]


def made_findings(n: int = MADE_ROWS, seed: int = 11) -> list[tuple[str, str, str, str, str, int]]:
    """Labelled candidates (value, kind, before, after, path, label) made by rule, for kinds that a corpus may lack.

    Random keys of the public shapes, beside the words they are found with, are true;
    placeholders, documentation keys, digests named as such, UUIDs, repeated characters,
    paths, plain numbers and running prose are false.
    """
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    syllables = "th re on an in er the ing ion ent est qu la de ou ver sch ado".split()
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    hexes, mixed, upper = string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_uppercase + string.digits
    out = []
    while len(out) < n:
        prose, after, path = " ".join(word() for _ in range(4)) + " ", " " + word(), r.choice(["", f"src{r.randint(0, 40)}", "config.py", "app/settings.yml", "notes"])
        key = r.choice(["password", "passwd", "secret", "token", "api_key", "access_key"]) + r.choice(["=", ": ", ' = "', " = "])
        true = r.random() < 0.5
        if true:
            kind, value, before = r.choice([
                ("aws_key", r.choice(["AKIA", "ASIA"]) + pick(upper, 16), prose),
                ("github_token", "ghp_" + pick(mixed, 36), prose),
                ("slack_token", "xoxb-" + pick(string.digits, 11) + "-" + pick(mixed, 24), prose),
                ("stripe_key", "sk_live_" + pick(mixed, 24), prose),
                ("google_key", "AIza" + pick(mixed + "_-", 35), prose),
                ("jwt", "eyJ" + pick(mixed, 20) + "." + pick(mixed, 40) + "." + pick(mixed + "_-", 43), prose),
                ("private_key", "-----BEGIN PRIVATE KEY-----\n" + pick(mixed + "+/", 300) + "\n-----END PRIVATE KEY-----", prose),
                ("assigned", pick(hexes, r.choice([16, 18, 20, 24, 32, 40])), prose + key), ("assigned", pick(mixed, r.choice([8, 12, 16, 24, 40, 400])), prose + key), ("assigned", pick(mixed + "!@#%+/", r.randint(8, 32)), prose + key),
                ("opaque", pick(mixed + r.choice(["", "+/"]), r.choice([24, 32, 40, 64, 200, 700])), prose + r.choice(["aws ", "key ", "secret ", "auth "])),
            ])
        else:
            sha = pick(hexes, r.choice([32, 40, 64]))
            kind, value, before = r.choice([
                ("aws_key", "AKIA" + r.choice(["IOSFODNN7EXAMPLE", "XXXXXXXXXXXXXXXX", "EXAMPLEKEY123456", "TESTTESTTEST1234", "0000000000000000"]), prose),
                ("github_token", "ghp_" + r.choice("xX0a") * 36, prose), ("stripe_key", "sk_test_" + "x" * 24, prose),
                ("assigned", r.choice(["changeme", "password", "your_password_here", "<secret>", "example123", "placeholder", "********", "xxxxxxxx", "${SECRET}", "os.environ", "$PASSWORD", "None", "undefined", "{{token}}", "testtest"]), prose + key),
                ("assigned", word() + r.choice([".", ",", "", word()]), prose + key), ("assigned", r.choice("x*.0-") * r.randint(6, 24), prose + key),
                ("opaque", sha, prose + r.choice(["commit ", "sha256:", "md5 ", "checksum ", "digest ", "etag "])), ("opaque", str(uuid.UUID(int=r.getrandbits(128))), prose + r.choice(["", "uuid ", "request "])),
                ("opaque", "/".join(word() for _ in range(5)) + str(r.randint(0, 99)), prose), ("opaque", "-".join(word() for _ in range(6)) + str(r.randint(0, 2030)), prose),
                ("opaque", "".join(word() for _ in range(6)) + str(r.randint(0, 9)), prose), ("opaque", "_" * 20 + "12345", prose), ("opaque", base64.b64encode((" ".join(word() for _ in range(9))).encode()).decode()[:40], prose + "image "),
                ("opaque", pick(string.digits, r.randint(16, 40)), prose), ("jwt", "eyJexample00." + "x" * 20 + "." + "y" * 20, prose), ("slack_token", "xoxb-your-token-here", prose),
            ])
        out.append((value, kind, before, after, path, int(true)))
    return out


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, nodes: list) -> int:
    at = len(nodes)
    nodes.append([-1, 0.0, -1, -1, float(y.mean())])
    if depth == 0 or len(y) < 2 * LEAST_LEAF or y.min() == y.max():
        return at
    best = (2 * y.mean() * (1 - y.mean()) - 1e-9, -1, 0.0)
    for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
        order = np.argsort(x[:, f], kind="stable")
        v, c = x[order, f], np.cumsum(y[order])
        cut = np.flatnonzero(v[1:] > v[:-1]) + 1
        cut = cut[(cut >= LEAST_LEAF) & (cut <= len(y) - LEAST_LEAF)]
        if len(cut):
            left, right = c[cut - 1] / cut, (c[-1] - c[cut - 1]) / (len(y) - cut)
            gini = (2 * left * (1 - left) * cut + 2 * right * (1 - right) * (len(y) - cut)) / len(y)
            k = int(gini.argmin())
            if gini[k] < best[0]:
                low, high = float(v[cut[k] - 1]), float(v[cut[k]])
                middle = (low + high) / 2
                best = (float(gini[k]), int(f), middle if middle < high else low)
    if best[1] >= 0:
        low = x[:, best[1]] <= best[2]
        nodes[at][:2] = best[1:]
        nodes[at][2] = _grow(x[low], y[low], rng, depth - 1, nodes)
        nodes[at][3] = _grow(x[~low], y[~low], rng, depth - 1, nodes)
    return at


class Forest:
    """Trees over bootstrap draws, each split on the best of a random few features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            draw = rng.integers(0, len(y), len(y))
            nodes: list = []
            _grow(x[draw], y[draw], rng, depth, nodes)
            self.trees.append(np.array(nodes))

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH + 1):
                node = tree[at]
                inner = node[:, 0] >= 0
                low = x[np.arange(len(x)), np.maximum(node[:, 0], 0).astype(int)] <= node[:, 1]
                at = np.where(inner, np.where(low, node[:, 2], node[:, 3]), at).astype(int)
            total += tree[at, 4]
        return total / len(self.trees)


def train(findings: list[tuple[str, str, str, str, str, int]]) -> Forest:
    x = np.array([features(v, k, b, a, p) for v, k, b, a, p, _ in findings])
    return Forest(x, np.array([label for *_, label in findings], float))


@functools.lru_cache(maxsize=1)
def default_forest() -> Forest:
    """The forest of made findings alone."""
    return train(made_findings())


def held_out(doc_id) -> Column:
    """Rows whose candidates are never learnt from; null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def label(value: str, kind: str, before: str) -> int:
    """The convention by which a corpus's candidates are labelled, as it has no labels of its own.

    A finding is a value that looks drawn (six different characters, none six times in a
    row, not a third of it dictionary words) and stands where secrets do: it has a
    provider's shape, is assigned to a credential's name, or follows one within two words.
    """
    lowered = re.sub("-----[^-]*-----", "", value).lower()
    words = [w.lower() for w in _WORDLIKE.findall(before)[-2:]]
    drawn = len(set(lowered)) >= 6 and not re.search(r"(.)\1{5}", lowered) and 3 * sum(len(w) for w in DICTIONARY if len(w) > 3 and w in lowered) < len(value)
    placed = kind != "opaque" or (any(w in NEAR_SECRETS for w in words) and not any(w in NEAR_DIGESTS for w in words))
    return int(drawn and placed)


def _context(text: str, c: Candidate) -> tuple[str, str]:
    return text[max(0, c.start - CONTEXT) : c.start], text[c.end : c.end + CONTEXT]


def corpus_findings(texts: list[str], paths: list[str]) -> list[tuple[str, str, str, str, str, int]]:
    """The labelled candidates of some texts."""
    out = []
    for text, path in zip(texts, paths):
        for c in candidates(text):
            before, after = _context(text, c)
            out.append((c.value, c.kind, before, after, path, label(c.value, c.kind, before)))
    return out


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Forest:
    """The forest of made findings and the labelled candidates of a bounded sample of documents.

    The sample is of documents that are not held out, in the order of a hash of their
    ids, ``sample_docs`` at most; where their texts take more than ``sample_bytes``, the
    longest are left out. Equal texts are learnt from once.
    """
    bound_batches(docs.sparkSession)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = docs.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(*order).limit(sample_docs)
    texts = docs.select("doc_id", "text", "source").where("text is not null").join(F.broadcast(some), "doc_id").withColumn("size", F.octet_length("text").cast("long"))
    shortest = texts.orderBy("size", *order, "text").limit(sample_docs).withColumn("upto", F.sum("size").over(Window.orderBy("size", *order, "text")))
    found = shortest.where(F.col("upto") <= sample_bytes).orderBy(*order, "text").select("text", "source").toArrow()
    unique = dict(zip(found.column("text").to_pylist(), found.column("source").to_pylist()))
    return train(made_findings() + corpus_findings(list(unique), [p or "" for p in unique.values()]))


def report(docs: DataFrame, forest: Forest, threshold: float = 0.5) -> dict[str, float]:
    """Precision and recall over held-out documents by :func:`label`, of all candidates and of those the forest leaves."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, paths in rows(batches, "text", "source"):
            texts, n = [t or "" for t in texts], [0, 0, 0, 0]
            for t, found in zip(texts, scan(texts, [p or "" for p in paths], forest, threshold)):
                for c, p in found:
                    true = label(c.value, c.kind, _context(t, c)[0])
                    n = [n[0] + 1, n[1] + true, n[2] + (p >= threshold), n[3] + (true and p >= threshold)]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in n], ["candidates", "true", "kept", "kept_true"])

    counts = docs.where(held_out(F.col("doc_id"))).select("text", "source").mapInArrow(run, "candidates long, true long, kept long, kept_true long")
    n = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts.columns]).first()
    share = lambda a, b: a / b if b else 1.0
    return {"candidates": n["candidates"], "precision_without": share(n["true"], n["candidates"]), "recall_without": 1.0, "precision": share(n["kept_true"], n["kept"]), "recall": share(n["kept_true"], n["true"])}


def scan(texts: list[str], paths: list[str], forest: Forest, threshold: float) -> list[list[tuple[Candidate, float]]]:
    """Candidates and their probabilities for each text; those under the threshold are false."""
    found = [candidates(t) for t in texts]
    x = [features(c.value, c.kind, *_context(t, c), p) for t, p, cs in zip(texts, paths, found) for c in cs]
    scores = iter(forest.probability(np.array(x)).tolist() if x else [])
    return [[(c, next(scores)) for c in cs] for cs in found]


def redacted(text: str, findings: list[tuple[Candidate, float]]) -> str:
    out, at = [], 0
    for c, _ in findings:
        out += [text[at : c.start], f"[{c.kind.upper()}]"]
        at = c.end
    return "".join([*out, text[at:]])


FINDING = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("kind", pa.string()), ("probability", pa.float64())])
FINDINGS_SCHEMA = "doc_id long, n_candidates long, n_findings long, findings array<struct<start: long, length: long, kind: string, probability: double>>"


def secret_findings(docs: DataFrame, threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """(doc_id, n_candidates, n_findings, findings) for each row of ``docs(doc_id, text, source, ...)``.

    Every whole text is scanned; a finding is a candidate that the forest, by default
    that of :func:`fit` over ``docs``, gives at least ``threshold``, with its code-point
    span. The path is the row's source. Null and empty texts have none; rows that repeat
    are scanned alike; an empty table gives no rows.
    """
    forest = forest or fit(docs)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("secrets", lambda: None)
        for ids, texts, paths in rows(batches, "doc_id", "text", "source"):
            found = scan([t or "" for t in texts], [p or "" for p in paths], forest, threshold)
            kept = [[{"start": c.start, "length": c.end - c.start, "kind": c.kind, "probability": p} for c, p in cs if p >= threshold] for cs in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(cs) for cs in found], pa.int64()), pa.array([len(k) for k in kept], pa.int64()), pa.array(kept, pa.list_(FINDING))], ["doc_id", "n_candidates", "n_findings", "findings"]
            )

    return docs.select("doc_id", "text", "source").mapInArrow(run, FINDINGS_SCHEMA)


def redact(docs: DataFrame, threshold: float = 0.5, forest: Forest | None = None) -> DataFrame:
    """``docs`` with all rows and columns; each finding in text gives way to its kind in brackets, and n_chars follows."""
    forest = forest or fit(docs)
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_cache("secrets", lambda: None)
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts, paths = batch.column(at).to_pylist(), batch.column(batch.schema.get_field_index("source")).to_pylist()
            found = scan([t or "" for t in texts], [p or "" for p in paths], forest, threshold)
            clean = [t if t is None else redacted(t, [(c, p) for c, p in cs if p >= threshold]) for t, cs in zip(texts, found)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(clean, batch.schema.field(at).type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
