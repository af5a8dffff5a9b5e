"""Source tables: what they are keyed by, and how they are read. One place for names, keys and date columns."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.panels import date_slice, in_pool, nan_to_null, normalise_code, normalise_panel, parse_date


@dataclass(frozen=True)
class Table:
    name: str
    keys: tuple[str, ...]
    #: The date that freshness is measured by; None for dimensions.
    date: str | None
    kind: str  # panel, event, report, dimension or bars
    overlap_days: int = 3


#: The tables that are ingested, with the full key of each.
TABLES = {
    t.name: t
    for t in (
        Table("daily", ("trade_date", "stock_code"), "trade_date", "panel"),
        Table("daily_adj", ("trade_date", "stock_code"), "trade_date", "panel"),
        Table("finance", ("trade_date", "stock_code"), "trade_date", "panel"),
        Table("margin_detail", ("trade_date", "stock_code"), "trade_date", "panel"),
        Table("main_fund_flow", ("trade_date", "stock_code"), "trade_date", "panel"),
        Table("dragon_tiger", ("trade_date", "stock_code", "org_name", "reason"), "trade_date", "event"),
        Table("top_list", ("trade_date", "stock_code", "reason"), "trade_date", "event"),
        Table("limit_up", ("trade_date", "stock_code"), "trade_date", "event"),
        Table("limit_list", ("trade_date", "stock_code", "limit"), "trade_date", "event"),
        Table("ths_daily", ("trade_date", "ths_code"), "trade_date", "panel"),
        Table("index_weight", ("trade_date", "index_code", "stock_code"), "trade_date", "panel", 35),
        Table("kline_weekly", ("trade_date", "stock_code"), "trade_date", "panel", 35),
        Table("kline_monthly", ("trade_date", "stock_code"), "trade_date", "panel", 35),
        Table("kline_adj_weekly", ("trade_date", "stock_code"), "trade_date", "panel", 35),
        Table("kline_adj_monthly", ("trade_date", "stock_code"), "trade_date", "panel", 35),
        Table("holder_number", ("stock_code", "end_date", "ann_date"), "ann_date", "report", 95),
        Table("pledge_stat", ("stock_code", "end_date"), "end_date", "report", 95),
        Table("financial_indicator", ("stock_code", "end_date", "ann_date"), "ann_date", "report", 95),
        Table("income", ("stock_code", "end_date", "ann_date"), "ann_date", "report", 95),
        Table("balancesheet", ("stock_code", "end_date", "ann_date"), "ann_date", "report", 95),
        Table("cashflow", ("stock_code", "end_date", "ann_date"), "ann_date", "report", 95),
        Table("calendar", ("date",), None, "dimension"),
        Table("stock_list", ("stock_code",), None, "dimension"),
        Table("ths_sector_categories", ("index_code",), None, "dimension"),
        Table("ths_constituent_stocks", ("index_code", "stock_code"), None, "dimension"),
        Table("cyq_chips", ("stock_code", "trade_date", "price"), "trade_date", "bars"),
        *[Table(f"{kind}_{n}min", ("stock_code", "trade_time"), "trade_time", "bars") for kind in ("history", "min_adj") for n in (15, 30, 60)],
    )
}
#: A code as the sources write it; columns of reports that are no values.
CODE_PATTERN = r"^\d{6}\.(SH|SZ|BJ)$"
REPORT_KEYS = ("stock_code", "code", "ann_date", "f_ann_date", "end_date", "report_type", "comp_type", "end_type", "update_flag")


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table's rows as stored, under ``root``, with neither NaN nor infinity."""
    return nan_to_null(spark.read.parquet(f"{root}/{name}.parquet"))


def clean_codes(df: DataFrame, code: str = "stock_code") -> DataFrame:
    return df.where(F.col(code).rlike(CODE_PATTERN))


def stored_between(df: DataFrame, start: dt.date | None, end: dt.date | None) -> DataFrame:
    """``df`` without most rows outside the dates, by filters on the stored column, which reach the scan.

    Dates as text are YYYY-MM-DD or YYYYMMDD; the first sort before the second of
    the same year, so the bounds are wide enough for both.
    """
    column = next((c for c in ("trade_date", "date", "Date") if c in df.columns), None)
    if column is None:
        return df
    text = df.schema[column].dataType.typeName() == "string"
    if start is not None:
        df = df.where(F.col(column) >= F.lit(start.isoformat() if text else start))
    if end is not None:
        after = end + dt.timedelta(days=1)
        df = df.where((F.col(column) <= f"{end:%Y%m%d}") if text else (F.col(column) < F.lit(after)))
    return df


def load_panel(spark: SparkSession, root: str, name: str, start: dt.date | None = None, end: dt.date | None = None, pool: DataFrame | None = None, lookback_days: int = 0) -> DataFrame:
    """(date, code, measures) with keys in one form, from ``lookback_days`` before ``start`` to ``end``, codes of the pool."""
    start = start - dt.timedelta(days=lookback_days) if start is not None else None
    df = normalise_panel(stored_between(spark.read.parquet(f"{root}/{name}.parquet"), start, end))
    df = date_slice(df, F.lit(start) if start is not None else None, F.lit(end) if end is not None else None)
    return df if pool is None else in_pool(df, pool)


def load_reports(spark: SparkSession, root: str, name: str, values: list[str] | None = None) -> DataFrame:
    """(code, ann_date, end_date, values) of a report table; where nothing is announced the period's end stands in."""
    df = read_table(spark, root, name)
    values = values or [c for c, kind in df.dtypes if c not in REPORT_KEYS and kind in ("double", "float", "int", "bigint")]
    day = lambda c: parse_date(F.col(c)) if df.schema[c].dataType.typeName() == "string" else F.col(c).cast("date")
    announced = day("ann_date") if "ann_date" in df.columns else day("end_date")
    return df.select(normalise_code(F.col("stock_code")).alias("code"), announced.alias("ann_date"), day("end_date").alias("end_date"), *[F.col(v).cast("double").alias(v) for v in values])


def load_pool(spark: SparkSession, path: str) -> DataFrame:
    """Codes of a text file, one a line."""
    return spark.read.text(path).where(F.trim("value") != "").select(normalise_code(F.col("value")).alias("code")).distinct()


def load_bars(spark: SparkSession, path: str) -> DataFrame:
    """One file per code: the code is the file's name, where the rows do not have it."""
    df = spark.read.option("mergeSchema", "true").parquet(path)
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^([^/]*?)(\.parquet)?$", 1)
    own = F.coalesce(F.col("stock_code"), stem) if "stock_code" in df.columns else stem
    return df.withColumn("code", normalise_code(own))


def max_date(df: DataFrame, date: str) -> DataFrame:
    """One row: the last date of rows that were not filled in."""
    real = df.where(~F.coalesce(F.col("is_backfill"), F.lit(False))) if "is_backfill" in df.columns else df
    return real.agg(F.max(date).alias("max_date"))


def table_path(root: str, name: str) -> str:
    return str(PurePosixPath(root) / f"{name}.parquet")
