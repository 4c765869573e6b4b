"""A training corpus from documents: toxicity, quality rules, near-dedup, secret scans, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdex.llm import minhash, packing, quality, secret_scan, toxicity
from verdex.llm.common import gathered, staged, table


#: Pieces in a worker's cache of the last stage: executors that have gone through the stages before have less memory to spare.
CACHE_PIECES = 100_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it learns from the labels of documents still here."""
    return gathered(toxicity.drop_toxic(docs, table(spark, sf_dir, "labels")), docs.count())


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior calls good; rules are weighed on the documents still here. Null and empty texts go."""
    return gathered(quality.keep_good(docs), docs.count())


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of word 5-shingle similarity 0.8 or more, that of the smallest doc_id."""
    return gathered(minhash.keep_one(docs, percent=80), docs.count())


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by their kinds; null and empty texts stay as they are."""
    return gathered(secret_scan.redact(docs), docs.count())


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: pieces of documents laid into sequences; a null or empty text is the end id alone."""
    packed = packing.packed_sequences(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0, cache_pieces=CACHE_PIECES)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", drop_toxic), ("quality", keep_good), ("near_dedup", drop_near_copies), ("secrets", redact_secrets), ("packing", pack)]

#: None: training, estimation and tokenizers have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each over all that the one before kept; without documents, no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
