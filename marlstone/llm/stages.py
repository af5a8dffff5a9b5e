"""The stages of the corpus pipeline: (spark, docs, sf_dir) to a DataFrame, each over all rows that it is given.

All but the last return the columns of ``docs``, those beside doc_id, text and
n_chars as they are, whatever their names. Null texts are scored, compared and
searched as empty ones, and stay null. Very long texts are read whole by every
stage. Of rows that repeat a text one stays, that with the smallest id; null ids
come last, and rows that tie go by their JSON. A score at the cut is kept. An
empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import decontaminate, pieces, ranker, secret_scan, simhash
from marlstone.llm._common import bounded_batches, read


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the pairwise ranker, trained on the training fold's labels, does not reject."""
    bounded_batches(spark)
    model = ranker.train(docs, read(spark, sf_dir, "labels").where(~ranker.held_out()))
    return docs.where(ranker.score_column(model)(F.col("text")) >= ranker.CUT)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without near-copies of rows that stay: runs of five words, a similarity of 0.8 or more."""
    bounded_batches(spark)
    return simhash.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no test item."""
    bounded_batches(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with the secrets in their texts replaced by a mark and n_chars, if there, counted anew."""
    bounded_batches(spark)
    out = docs.withColumn("text", secret_scan.redacted("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), F.col("n_chars")))
    return out.select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces, ids and round_trip of every row."""
    bounded_batches(spark)
    return pieces.encode(docs, carry=("lang", "source"))
