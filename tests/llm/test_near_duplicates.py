from __future__ import annotations

import random
import re
from pathlib import Path

import numpy as np
import pytest

from verdex.llm import minhash
from verdex.llm.minhash import keep_one, near_duplicates
from verdex.plans import skew

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, cls string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(docs, percent=85):
    sets = [(d, shingles(t)) for d, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (d, a) in enumerate(sets):
        for j, (e, b) in enumerate(sets[:i]):
            if a and b and (100 * len(a & b) >= percent * len(a | b)):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(sets):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(s), least[find(i)], least[find(i)] == d) for i, (d, s) in enumerate(sets)}


def family(seed=3):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6)))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(r.choice([3, 8, 60, 200]))]
        texts.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 3, 12])):
            copy = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 3])):
                copy[r.randrange(len(copy))] = word()
            texts.append((" " if r.random() < 0.5 else "\n").join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    chain = [word() for _ in range(300)]
    for i in range(12):
        chain = chain[2:] + [word() for _ in range(2)]
        texts.append("\t".join(chain))
    texts += ["", "   ", "one", "ONE", "one two", "a b c d e f", "A b c d e f", "É b c d e", "é b c d e", "w " * 5000]
    r.shuffle(texts)
    return list(enumerate(texts))


def test_components_match_brute_force(spark):
    docs = family()
    df = spark.createDataFrame([(d, t, "en", "s", len(t), "x") for d, t in docs], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == brute(docs)


@pytest.mark.parametrize("few_ids", [True, False])
def test_one_large_family_matches_brute_force(spark, monkeypatch, few_ids):
    """Its buckets, head, part and component are hot keys, as are the class of one text that many rows repeat and that of no words."""
    monkeypatch.setattr(skew, "HOT_ROWS", 50)
    monkeypatch.setattr(minhash, "BROADCAST_IDS", 10**6 if few_ids else 0)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(45)]
    texts = []
    for i in range(2000 if few_ids else 300):
        copy = list(base)
        for _ in range(r.choice([0, 1, 1])):
            copy[r.choice([0, 1, 43, 44, r.randrange(45)])] = word()
        texts.append(" ".join(copy))
    texts += [" ".join(word() for _ in range(30)) for _ in range(40)] + ["all the same words in every one of these"] * 200 + [""] * 150
    r.shuffle(texts)
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(d, t, "en", "s", len(t), "x") for d, t in docs], SCHEMA)
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_nulls_repeats_and_no_rows(spark):
    text = "a b c d e f g"
    rows = [(1, text), (1, text), (None, text), (3, None), (None, None), (4, "x y"), (4, "z"), (5, "z")]
    df = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()), key=repr)
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (None, 3, 1, False), (3, 0, 3, True), (None, 0, None, True), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False)], key=repr)
    assert sorted(str(r["doc_id"]) for r in keep_one(df).collect()) == ["1", "3", "4", "None"]
    assert keep_one(df).columns == df.columns
    assert near_duplicates(df.limit(0)).count() == 0


def test_short_near_copies_match_brute_force(spark):
    r = random.Random(4)
    docs = []
    for n, less in [(7, 1)] * 200 + [(8, 1), (14, 2), (15, 2), (16, 2), (20, 3), (27, 4)] * 25:
        words = ["".join(r.choice("abcdefgh") for _ in range(8)) for _ in range(n + 4)]
        docs += [" ".join(words), " ".join(words[:-less])]
    docs = list(enumerate(docs))
    df = spark.createDataFrame([(d, t, "en", "s", len(t), "x") for d, t in docs], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect()}
    assert got == brute(docs)


def test_null_ids_stay_whatever_else_repeats(spark):
    a, b, c = "a b c d e f g", "k l m n o p q", "r s t u v w x"
    rows = [(None, b), (None, c), (None, None), (None, a), (1, a), (1, a)]
    for rows in (rows, rows[:-1]):
        df = spark.createDataFrame([(d, t, None, None, None, None) for d, t in rows], SCHEMA)
        got = [(r["doc_id"], r["text"]) for r in keep_one(df).collect()]
        assert sorted(got, key=repr) == sorted([(None, b), (None, c), (None, None), (1, a)], key=repr)


def test_few_rows_are_written_in_few_files(spark):
    """An executor starts two processes for each file it writes; with 64 shuffle partitions most tables came in as many files."""
    r = random.Random(12)
    base = [" ".join(r.choice("abcdefghij") + str(r.randrange(60)) for _ in range(40)) for _ in range(150)]
    docs = list(enumerate(base + [b + " end" for b in base] + base[:50]))
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    root = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://")) / "verdex"
    old = {*root.glob("*")}
    try:
        for k, v in zip(held, ("64", "false")):
            spark.conf.set(k, v)
        rows = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(32)).collect()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"], x["kept"]) for x in rows} == brute(docs)
    files = {p.name: len(list(p.glob("part-*"))) for p in {*root.glob("*")} - old}
    assert files and max(files.values()) <= spark.sparkContext.defaultParallelism, files


def test_estimate_is_collision_corrected():
    rng = np.random.default_rng(0)
    pool = np.unique(rng.integers(0, 2**64, 3000, dtype=np.uint64))
    for shared in (0.5, 0.85):
        n = 1000
        k = int(2 * n * shared / (1 + shared))
        a, b = pool[:n], pool[n - k : 2 * n - k]
        x, y = minhash.packed(minhash.minima(a)).view(np.uint64), minhash.packed(minhash.minima(b)).view(np.uint64)
        differ = (x ^ y)[: minhash.LONGS] | (x ^ y)[minhash.LONGS :]
        agree = minhash.MINIMA - sum(int(v).bit_count() for v in differ)
        estimate = (agree / minhash.MINIMA - 0.25) / 0.75
        assert estimate == pytest.approx(k / (2 * n - k), abs=0.06)


def test_long_text_and_blocks_agree():
    text = " ".join(str(i) for i in range(20_000))
    assert len(minhash.shingle_hashes(text)) == 19_996
    half = minhash.minima(minhash.shingle_hashes(text), 64)
    assert (half == minhash.minima(minhash.shingle_hashes(text))[:64]).all()
