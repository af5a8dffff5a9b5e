"""The corpus pipeline: quality, near-duplicates, decontamination, secrets, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's docs. All stages but the last
return the columns that they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import stages
from marlstone.llm._common import read, stored

STAGES = [
    ("quality_classifier", stages.quality_stage),
    ("simhash_dedup", stages.dedup_stage),
    ("decontamination", stages.decontamination_stage),
    ("secret_scans", stages.secrets_stage),
    ("encoding", stages.encoding_stage),
]

#: SQL expresses neither the trained classifier nor the fingerprints; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet to the shared checkpoint folder and read from there."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
