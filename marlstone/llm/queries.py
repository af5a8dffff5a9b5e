"""The operators' queries: each applies its operator to the whole table and returns one digest row per document (or hit)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, langid, oracles, pieces, quality_rules, ranker, secret_scan, simhash, suffix_dedup, token_counts, toxicity
from marlstone.llm._common import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(read(spark, sf_dir, "documents"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.quality_rules(read(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return out.select(*first, "n_lines", "n_upper", "n_marks", "failed_rules")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    held = langid.identify(docs, model)
    return held.withColumn("held_out", langid.held_out()).select("doc_id", "held_out", "lang_pred", "score")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = ranker.train(docs, read(spark, sf_dir, "labels").where(~ranker.held_out()))
    return ranker.score(docs, model).withColumn("held_out", ranker.held_out()).select("doc_id", "held_out", "score", "predicted")


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.find_secrets(read(spark, sf_dir, "documents")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts.count_tokens(read(spark, sf_dir, "documents"))
    return counted.withColumn("over_limit", F.col("n_tokens") > token_counts.LIMIT_TOKENS)


def op8_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = toxicity.train(docs, read(spark, sf_dir, "labels").where(~toxicity.held_out()))
    return toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_decontamination, op2_sentencepiece, op3_quality_rules, op4_language_id, op5_quality_classifier, op6_secret_scans, op7_token_counts, op8_simhash_dedup, op9_suffix_dedup, op10_toxicity)}
#: The others rest on trained models, a library's tokens, or hashes that SQL lacks; tests hold them against brute force.
ORACLES: dict[str, str] = {"op3_quality_rules": oracles.quality_rules_sql()}
