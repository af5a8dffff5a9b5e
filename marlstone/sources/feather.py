"""Wide factor files (dates by codes, Feather) as one long table, a base file and its increments merged.

Files are parsed on the executors, one by one; a file is a few thousand dates by
a few thousand codes.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.feather as feather
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.panels import upsert
from marlstone.sources.files import Folder

#: What an increment's file name ends with, and the column of dates.
INCREMENT = "_incr"
DATE_COLUMNS = ("Date", "date", "index")


def read_factors(spark: SparkSession, path: str) -> DataFrame:
    """(factor, date, code, value) of all files that ``path`` matches, dates as text; an increment's values replace the base's."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wide = feather.read_feather(io.BytesIO(content))
                date = next((c for c in DATE_COLUMNS if c in wide.columns), None)
                wide = wide.set_index(date) if date else wide
                long = wide.stack().dropna()
                stem = re.sub(r"^.*/|\.[^./]*$", "", name)
                n = len(long)
                yield pa.RecordBatch.from_pydict({
                    "factor": pa.array([stem.removesuffix(INCREMENT)] * n, pa.string()),
                    "date": pa.array([str(x).replace("-", "")[:8] for x in long.index.get_level_values(0)], pa.string()),
                    "code": pa.array([str(x) for x in long.index.get_level_values(1)], pa.string()),
                    "value": pa.array(long.to_numpy(), pa.float64()),
                    "late": pa.array([stem.endswith(INCREMENT)] * n, pa.bool_()),
                })

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(parse, "factor string, date string, code string, value double, late boolean")
    base, late = (rows.where(F.col("late") == x).drop("late") for x in (False, True))
    return upsert(base, late, ["factor", "date", "code"])


def wide_files(values: DataFrame) -> DataFrame:
    """(factor, content): the Feather file, dates by codes, of each factor of (factor, date, code, value); a task for each."""

    def pack(table: pa.Table) -> pa.Table:
        wide = table.to_pandas().pivot_table(index="date", columns="code", values="value", aggfunc="max", dropna=False).sort_index()
        wide.columns = [str(c) for c in wide.columns]
        out = io.BytesIO()
        feather.write_feather(wide.rename_axis("Date").reset_index(), out)
        return pa.table({"factor": pa.array([table.column("factor")[0].as_py()], pa.string()), "content": pa.array([out.getvalue()], pa.binary())})

    return values.select("factor", F.col("date").cast("string").alias("date"), F.col("code").cast("string").alias("code"), "value").groupBy("factor").applyInArrow(pack, "factor string, content binary")


def write_factors(values: DataFrame, path: str, increment: bool = False) -> list[str]:
    """Write a file for each factor; their names. One file at a time passes through the driver."""
    folder, names = Folder(values.sparkSession, path), []
    for row in wide_files(values).toLocalIterator():
        names.append(f"{row.factor}{INCREMENT if increment else ''}.feather")
        folder.write(names[-1], bytes(row.content))
    return sorted(names)
