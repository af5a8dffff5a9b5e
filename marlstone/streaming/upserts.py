"""Keyed upserts by Structured Streaming: late rows replace earlier ones of their key, or are added to them.

Each micro-batch is merged by key into a stored table, written beside the old
version and then named as the current one. What is current is told by markers in
the table's folder, so a stream that starts again goes on from there, and a
batch that is run again gives the same table.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.operators.panels import upsert
from marlstone.sources.files import Folder, Versions


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares; below a temporary one only on a local master without one."""
    root = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="marlstone-")
    return f"{root}/stream-{uuid.uuid4().hex}"


Merge = Callable[[DataFrame, DataFrame], DataFrame]


class KeyedTable:
    """A table in versions; the current one is that of the last batch merged. ``merge`` brings stored and new rows together."""

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], merge: Merge | None = None) -> None:
        self.spark, self.versions = spark, Versions(Folder(spark, folder))
        self.combine = merge or (lambda stored, new: upsert(stored, new, keys))

    def merge(self, batch: DataFrame, batch_id: int) -> None:
        done = self.versions.current()
        if done is not None and done["batch"] >= batch_id:
            return  # run again after a failure: its rows are in already
        merged = batch if done is None else self.combine(self.spark.read.parquet(done["path"]), batch)
        path = self.versions.place(batch_id)
        merged.write.mode("overwrite").parquet(path)
        self.versions.name(batch_id, {"batch": batch_id, "path": path})

    def read(self) -> DataFrame:
        done = self.versions.current()
        if done is None:
            raise ValueError("no batch has been merged")
        return self.spark.read.parquet(done["path"])


def stream_upsert(
    spark: SparkSession, source: str, keys: list[str], prepare: Callable[[DataFrame], DataFrame], merge: Merge | None = None, folder: str | None = None, files_per_batch: int | None = None
) -> DataFrame:
    """Stream Parquet files that are there into a keyed table; ``prepare`` brings a micro-batch to one row per key.

    With a ``folder``, a later call goes on with the files that came since.
    """
    folder = folder or shared_folder(spark)
    table = KeyedTable(spark, f"{folder}/table", keys, merge)
    reader = spark.readStream.schema(spark.read.parquet(source).schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    rows = reader.parquet(source)
    query = rows.writeStream.foreachBatch(lambda df, i: table.merge(prepare(df), i)).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return table.read()
