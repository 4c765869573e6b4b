from __future__ import annotations

import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from verdex.llm import packing, piece_model, token_counts, token_files, tokens

SCHEMA = "doc_id long, text string, n_tokens int"
ODD = ["", " ", "\n", " a", "a ", "a\n", "\na", "a \n b", "a\n\nb", "a  b", "a\tb", "Σας ΣΑΣ\nΣ", "it's they'RE 'll", "x <|endoftext|> y", "é é ́x", "漢字 かな", "😀 ok", "a\rb", "1234 a1b2", "▁ x", "a 　b", "\x00a", "a\x85b", "á \ń", "<0x0A> <s> x </s>", "..., !!", "a \nb", "long " * 9000, "z" * 3000]
DOCS = [*enumerate(ODD), (None, "a b"), (None, None), (7, None), (3, "again a"), (3, "again a")]


def ids(name, text):
    return Tokenizer.from_file(P.path(name)).encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cut_encoding_equals_whole(name):
    encoder = tokens.IdEncoder(P.path(name))
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in encoder.encode_batch(ODD)]
        assert got == [e.ids for e in Tokenizer.from_file(P.path(name)).encode_batch(ODD, add_special_tokens=False)]


def test_cache_generations(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PIECES", 3)
    cache = tokens.PieceCache(lambda pieces: [p.upper() for p in pieces])
    for batch in ([["a", "b"], ["c", "d"]], [["a", "e"]], [["x" * 99, "a", "b", "f", "g"]], [[]], [["g", "a"]]):
        assert cache.lookup(batch) == [[p.upper() for p in pieces] for pieces in batch]


def test_only_the_last_operators_cache_is_held():
    from verdex.llm import common

    released = []
    common.hold_cache("one", lambda: released.append("one"))
    common.hold_cache("one", lambda: released.append("one"))
    assert released == []
    first = tokens.id_encoder(P.path("word_bpe_49k.json"))
    assert released == ["one"] and tokens.id_encoder(P.path("word_bpe_49k.json")) is first
    tokens.piece_counter(P.path("piece_bpe_32k.model"))
    assert tokens.id_encoder(P.path("word_bpe_49k.json")) is not first


def test_piece_counts_equal_library():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert tokens.PieceCounter(P.path("piece_bpe_32k.model")).count_batch(ODD) == [len(x) for x in model.encode(ODD)]


def test_rebuilt_model_has_parity(spark):
    path = P.path("piece_bpe_32k.model")
    assert piece_model.parity(path, ODD) == []
    got = piece_model.piece_ids(spark.createDataFrame([(d, t, 0) for d, t in DOCS], SCHEMA), path).collect()
    assert len(got) == len(DOCS) and all(r["round_trip"] for r in got if "▁" not in (dict(DOCS).get(r["doc_id"]) or ""))
    assert all(zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"] for r in got)


def test_every_row_is_held_against_the_library(spark):
    path = P.path("piece_bpe_32k.model")
    got = piece_model.piece_ids(spark.createDataFrame([(d, t, 0) for d, t in DOCS], SCHEMA), path).collect()
    assert len(got) == len(DOCS) and all(r["parity"] is True for r in got)


def test_texts_are_decoded_as_the_library_does():
    model = piece_model.piece_model(P.path("piece_bpe_32k.model"))
    rng = np.random.default_rng(1)
    some = [*model.encode_batch(ODD), *[rng.integers(0, len(model.model.pieces), 40).astype("<u4").tobytes() for _ in range(200)], *[rng.integers(0, 300, 6).astype("<u4").tobytes() for _ in range(500)]]
    assert model.decode_batch(some) == model.tokenizer.decode_batch([np.frombuffer(x, "<u4").tolist() for x in some], skip_special_tokens=False)


def test_rebuilt_model_encodes_each_piece_once_as_in_the_whole_text():
    model = piece_model.PieceModel(P.path("piece_bpe_32k.model"), threads=False)
    r, seen = random.Random(3), []
    model._cache._encode_many = lambda pieces: (seen.extend(pieces), model._encode_pieces(pieces))[1]
    made = ["".join(r.choice([" ", " ", "\n", "a", "the", "ing", "\u00e9", "\u6f22", "\U0001f600", "\t", "<0x0A>", ".", "\u2581", "\x00", "\r"][: r.choice([12, 15])]) for _ in range(r.randint(1, 60))) for _ in range(2000)]
    texts = [t for t in ODD + made if t]
    for _ in range(2):
        assert model.encode_batch(texts) == model._encode_whole(texts)
    short = [p for p in seen if len(p) <= tokens.CACHE_CHARS]
    assert seen and len(short) == len(set(short))


def test_unigram_models_are_rebuilt(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, True
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces = "identity", False
    for piece, score, kind in [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), *[(f"<0x{i:02X}>", 0, 6) for i in range(256)], ("▁", -2, 1), ("a", -2.5, 1), ("b", -3, 1), ("ab", -3.5, 1), ("▁ab", -4, 1), ("ba", -3.25, 1)]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = tmp_path / "u.model"
    path.write_bytes(m.SerializeToString())
    assert piece_model.parity(str(path), ["ab ab", "abab ba", "bab ab ab", "ab é"]) == []


def test_token_files_round_trip(spark):
    df = spark.createDataFrame([(d, t, 0) for d, t in DOCS], SCHEMA).repartition(3)
    manifest = token_files.write_token_files(df, P.path("byte_bpe_50k.json"))
    got = [tuple(r) for r in token_files.read_token_index(manifest).orderBy("start").collect()]
    start, want = 0, []
    for d, t in sorted(DOCS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        data = np.array([*ids("byte_bpe_50k.json", t), 0], "<u4").tobytes()
        want.append((d, start, len(data) // 4, zlib.crc32(data)))
        start += len(data) // 4
    assert got == want
    assert token_files.read_token_index(token_files.write_token_files(df.limit(0), P.path("byte_bpe_50k.json"))).count() == 0


def test_counts_and_cache(spark, tmp_path):
    df = spark.createDataFrame([(d, t, 0) for d, t in DOCS], SCHEMA)
    path, cache = P.path("piece_bpe_32k.model"), f"file://{tmp_path}/cache"
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    want = sorted(((d, len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 10) for d, t in DOCS), key=repr)
    for _ in range(2):
        assert sorted((tuple(r) for r in token_counts.token_counts(df, path, 10, cache).collect()), key=repr) == want
        assert spark.read.parquet(cache).count() == len({t or "" for _, t in DOCS})
    word = P.path("word_bpe_49k.json")
    assert {r["doc_id"]: r["n_tokens"] for r in token_counts.token_counts(df, word, 10, cache).where("doc_id = 12").collect()} == {12: len(ids("word_bpe_49k.json", ODD[12]))}
    assert token_counts.token_counts(df.limit(0), path).count() == 0


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_is_whole_and_gapless(spark):
    df = spark.createDataFrame([(d, t, 0) for d, t in DOCS], SCHEMA)
    rows = packing.packed_sequences(df, P.path("word_bpe_49k.json")).collect()
    check_packing(rows, packing.CAPACITY)
    got = sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=repr)
    want = []
    for d, t in DOCS:
        x = [*ids("word_bpe_49k.json", t), 0]
        want += [(d, i, at, len(x[at : at + 2048]), zlib.crc32(np.array(x[at : at + 2048], "<u4").tobytes())) for i, at in enumerate(range(0, len(x), 2048))]
    assert got == sorted(want, key=repr)
    assert packing.packed_sequences(df.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_exchange_lowers_the_count_and_the_bound_holds(spark):
    rng = np.random.default_rng(4)
    lengths = rng.integers(20, 60, 900).tolist()
    df = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(lengths)], packing.PIECE_SCHEMA)
    one = check_packing(packing.pack(df, 100, items=40, exchanges=0).collect(), 100)
    more = check_packing(rows := packing.pack(df, 100, items=40, exchanges=3).collect(), 100)
    assert packing.lower_bound(np.array(lengths), 100) <= more <= one and len(rows) == 900


def test_dual_feasible_bound_against_search():
    rng = np.random.default_rng(1)

    def fewest(items, capacity):
        best = len(items)

        def place(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for k in {r: k for k, r in enumerate(rooms) if r >= items[i]}.values():
                place(i + 1, [*rooms[:k], rooms[k] - items[i], *rooms[k + 1 :]])
            place(i + 1, [*rooms, capacity - items[i]])

        place(0, [])
        return best

    for _ in range(40):
        items = sorted(rng.integers(1, 21, rng.integers(1, 9)).tolist(), reverse=True)
        least = fewest(items, 20)
        assert packing.lower_bound(np.array(items), 20) <= least <= int(packing.best_fit_decreasing(np.array(items), 20).max()) + 1
    assert packing.lower_bound(np.array([11] * 5 + [9] * 2), 20) == 5
