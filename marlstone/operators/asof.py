"""As-of panels: reports carried forward to every day of a calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof_panel(reports: DataFrame, calendar: DataFrame, values: list[str], ann_date: str = "ann_date", order: tuple[str, ...] = ("end_date",), code: str = "code", date: str = "date") -> DataFrame:
    """(date, code, values): for every code and calendar day, each column's last value announced by then.

    Of a day's reports the last in ``order`` counts, column by column, skipping
    NULLs. Reports on days that the calendar lacks, or without a date, are lost.
    The fill runs over reports, which are few; each is then spread over the days
    until the next one, so no grid of codes and days is joined or sorted.
    """
    days = calendar.select(date).where(F.col(date).isNotNull()).distinct()
    span = days.agg(F.min(date).alias("_first"), F.max(date).alias("_last"))  # one row
    known = reports.select(code, F.col(ann_date).alias("_at"), *order, *values)
    # an empty report on the first day: rows before a code's first report exist, and are NULL
    codes = known.select(code).where(F.col(code).isNotNull()).distinct().join(F.broadcast(span.select("_first")), F.lit(True))
    empty = codes.select(code, F.col("_first").alias("_at"))
    inside = known.join(days.withColumnRenamed(date, "_at"), "_at", "left_semi")
    when = f"struct({', '.join(order)})"
    merged = inside.unionByName(empty, allowMissingColumns=True).groupBy(code, "_at").agg(*[F.expr(f"max_by(`{c}`, {when}) FILTER (WHERE `{c}` IS NOT NULL)").alias(c) for c in values])
    w = Window.partitionBy(code).orderBy("_at")
    filled = merged.select(code, "_at", F.lead("_at").over(w).alias("_next"), *[F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in values])
    spread = filled.join(F.broadcast(span.select("_last")), F.lit(True)).select(
        F.explode(F.sequence("_at", F.coalesce(F.date_sub("_next", 1), F.col("_last")))).alias(date), code, *values
    )
    return spread.join(days, date, "left_semi")
