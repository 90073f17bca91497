"""Queries of the training-data operators for the driver: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, line_dedup, minhash, packed_ids, packing, pii, quality_gbdt, quality_rules, token_counts, toxicity
from .common import documents
from .oracle import ORACLE_SQL
from .text_stats import BASE

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), limit=1024)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.score_toxicity(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.5)
    return found.select("doc_id", "held_out", "score", "predicted", "n_sentences", F.size("offending").alias("n_offending"))


def op3_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = packed_ids.write_shards(documents(spark, sf_dir), tokenizer_path(BYTE_BPE), end_id=0)
    return packed_ids.read_shards(shards)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    more = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.TERM_KINDS]
    every = F.size(F.concat(*pii.KINDS, *pii.TERM_KINDS)).cast("long").alias("n_spans")
    return found.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans", *more, every)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbdt.score_quality(documents(spark, sf_dir), table(spark, sf_dir, "labels"), threshold=0.3)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge_quality(documents(spark, sf_dir), min_words=20, repeat_percent=30)
    return judged.select("doc_id", *BASE, "base_failed", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and where it stands."""
    leaks = decontam.find_leaks(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "score", "start", "end")


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_path(WORD_BPE), capacity=2048, end_id=0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_toxicity, op3_packed_ids, op4_line_dedup, op5_pii, op6_quality_classifier, op7_quality_rules,
        op8_decontamination, op9_minhash_dedup, op10_best_fit_packing,
    )
}
