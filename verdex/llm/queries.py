"""The training-data queries that the entry module registers, and SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table
from .html_extract import extract
from .media import media_columns
from .minhash import near_duplicates
from .packing import packed_sequences
from .piece_model import piece_ids
from .quality import quality
from .secret_scan import secret_findings
from .token_counts import token_counts
from .token_files import read_token_index, write_token_files
from .toxicity import toxicity

BYTE_BPE = "byte_bpe_50k.json"
WORD_BPE = "word_bpe_49k.json"
PIECE_BPE = "piece_bpe_32k.model"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), keep_ids=False).drop("ids")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_token_index(write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE), end_id=0))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_sequences(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), end_id=0)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_findings(table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_BPE), limit=4096)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_minhash_near_dedup,
        op2_sentencepiece,
        op3_quality_rules,
        op4_html_extraction,
        op5_toxicity,
        op6_media_columns,
        op7_token_files,
        op8_best_fit_packing,
        op9_token_counts,
        op10_secret_scans,
    )
}

#: The other queries need a tokenizer, a trained model, an estimate or stored bytes; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_near_dedup": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
  s as (select doc_id, list_distinct(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) end) as s from w),
  u as (select doc_id, len(s) as n, unnest(s) as x from s),
  p as (select a.doc_id as a, b.doc_id as b from u a join u b on a.x = b.x and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
  e as (select a, b from p union select b, a from p), r(node, label) as (select a, a from e union select e.b, r.label from r join e on e.a = r.node), c as (select node, min(label) as label from r group by 1)
  select s.doc_id, len(s.s) as n_shingles, coalesce(c.label, s.doc_id) as component_id, coalesce(c.label, s.doc_id) = s.doc_id as kept from s left join c on c.node = s.doc_id""",
}
