"""Token counts through a digest cache: only texts that the cache lacks are encoded."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_dir, rows, staged
from .tokens import file_digest, library_counter

#: Digests that a task remembers, so as not to encode rows that repeat; beyond them it forgets and would encode one again, to the same count.
SEEN_DIGESTS = 1 << 17
CACHE_SCHEMA = "digest binary, tokenizer binary, n_tokens long"


def _counter(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = library_counter(tokenizer)
        # Rows that repeat a doc_id and its text meet in one task, as both are keys of the join.
        seen: set[bytes] = set()
        for found in rows(batches, "digest", "text"):
            fresh = {d: t for d, t in zip(*found) if d not in seen}
            if len(seen) > SEEN_DIGESTS:
                seen.clear()
            seen.update(fresh)
            digests, texts = list(fresh), list(fresh.values())
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(count(texts), pa.int64())], ["digest", "n_tokens"])

    return run


def _normaliser(tokenizer: str):
    """The tokenizer's own normaliser where the count depends on its result alone, or none where that is the text itself.

    A sentencepiece model encodes nothing but what its normaliser gives. A file of the
    tokenizers library may look for added tokens in the raw text: such texts stay as they are.
    """
    if tokenizer.endswith(".model"):
        from sentencepiece import sentencepiece_model_pb2 as pb

        spec = pb.ModelProto()
        with open(tokenizer, "rb") as f:
            spec.ParseFromString(f.read())
        plain = spec.normalizer_spec
        if not plain.precompiled_charsmap and not plain.remove_extra_whitespaces:
            return None
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=tokenizer).normalize
    from tokenizers import Tokenizer

    loaded = Tokenizer.from_file(tokenizer)
    if loaded.normalizer is None:
        return None
    added = [t.content.lower() for t in loaded.get_added_tokens_decoder().values()]
    return lambda text: text if any(a in text.lower() for a in added) else loaded.normalizer.normalize_str(text)


def _normalised(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise = _normaliser(tokenizer)
        for batch in batches:
            texts = pa.array([normalise(t) for t in batch.column(1).to_pylist()], pa.string())
            yield batch.append_column("content", texts)

    return run


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 4096, cache: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row of ``docs(doc_id, text, ...)``.

    ``cache`` is a folder of Parquet rows (digest, tokenizer, n_tokens) kept between
    calls; without one, a new one in the shared folder serves this call. The content
    digest is SHA-256 of the text (null counts as empty) as the tokenizer's own
    normaliser gives it, so that texts it makes equal share one count; where that is the
    identity, as in the model at hand, no Python code runs for it. The tokenizer's digest
    is that of its file, so that a new version never reads old counts. Of each digest that
    the cache lacks one row's text is encoded, whatever number of rows share it.
    Appending twice after a failure leaves equal rows, which are read as one. An empty
    table gives no rows and appends none.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    version = bytes.fromhex(file_digest(tokenizer))
    cache = cache or fresh_dir(spark, "token-count-cache")
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache)
    stored = lambda: spark.read.schema(CACHE_SCHEMA).parquet(cache).where(F.col("tokenizer") == F.lit(version)).select("digest", "n_tokens").distinct()

    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    if _normaliser(tokenizer) is None:
        docs = docs.withColumn("content", F.col("text"))
    else:
        docs = docs.mapInArrow(_normalised(tokenizer), "doc_id long, text string, content string")
    keyed = staged(docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.unhex(F.sha2("content", 256)).alias("digest")), "token-digests")
    misses = keyed.groupBy("digest").agg(F.min("doc_id").alias("first_id")).join(stored(), "digest", "left_anti")
    texts = docs.withColumn("digest_here", F.unhex(F.sha2("content", 256)))
    texts = texts.join(misses.hint("shuffle_hash"), texts["doc_id"].eqNullSafe(misses["first_id"]) & (texts["digest_here"] == misses["digest"])).select("digest", "text")
    texts.mapInArrow(_counter(tokenizer), "digest binary, n_tokens long").select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return keyed.join(stored(), "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
