"""Shared plumbing: Arrow-batched per-text functions, checkpoints and folds."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from marlstone.sources.shipping import ship_package

#: Bytes of one Arrow batch handed to a Python worker; a batch of very long
#: texts is cut by bytes, one of short texts by rows.
BATCH_BYTES = 8 << 20
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session, so that memory per worker does not depend on text lengths."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names; make one only on a local master that names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="marlstone-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder once and read it from there."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder in the shared checkpoint folder, removed at the end: for tables that are needed no longer once what is made of them is written."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """``df`` as a Parquet table in ``folder`` or else the shared checkpoint folder, of which no column but those asked for is read again."""
    spark = df.sparkSession
    if folder is None:
        ensure_checkpoint_dir(spark)
        folder = spark.sparkContext.getCheckpointDir()
    path = f"{folder}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(batch: pa.RecordBatch, index: int = 1) -> list[str]:
    """The texts of a batch; null reads as the empty text."""
    return [x or "" for x in batch.column(index).to_pylist()]


def map_texts(
    df: DataFrame,
    make: Callable[[], Callable[[list[str]], list]],
    fields: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One output row per input row: ``id_col``, the ``carry`` columns, then ``fields``.

    ``make()`` runs once per task and returns a function from a list of texts to
    one array (or list) per field. Only the named columns are read, so extra
    columns, whatever their names, neither cost anything nor clash.
    """
    bounded_batches(df.sparkSession)
    added = T._parse_datatype_string(fields)
    read = df.select(F.col(id_col), F.col(text_col), *[F.col(c) for c in carry])
    kept = [read.schema[id_col], *[read.schema[c] for c in carry]]
    schema = T.StructType(kept + list(added.fields))
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            made = work(texts_of(batch))
            columns = [batch.column(0), *batch.columns[2:]]
            columns += [x if isinstance(x, pa.Array) else pa.array(x, type=arrow.field(len(columns) + i).type) for i, x in enumerate(made)]
            columns = [c.cast(arrow.field(i).type) if c.type != arrow.field(i).type else c for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return read.mapInArrow(run, schema)


def text_column(make: Callable[[], Callable[[list[str]], list]], returns: str) -> Callable[[Column], Column]:
    """A column function from text to one value, Arrow-batched, for use inside a wider row."""
    import pandas as pd

    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        work = make()
        for x in series:
            yield pd.Series(work([t if isinstance(t, str) else "" for t in x])[0])

    run.__annotations__ = {"series": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, returnType=returns)


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)), F.lit(0))


def bounded_sample(df: DataFrame, rows: int, key: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows, picked by a hash of the key, so that the same table gives the same rows."""
    return df.orderBy(F.xxhash64(F.col(key).cast("string"), F.lit("sample")), F.col(key)).limit(rows)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
