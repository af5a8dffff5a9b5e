"""Incremental ingest: what to fetch of each table, and how to merge what came."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators.panels import backfill, upsert
from marlstone.sources.files import Folder
from marlstone.sources.tables import TABLES, Table, max_date


def fetch_start(table: Table, last: dt.date | None, first: dt.date, stale_days: int = 0) -> dt.date:
    """From which date to fetch: an overlap before the last date, widened if codes lag behind."""
    return first if last is None else max(first, last - dt.timedelta(days=table.overlap_days + stale_days))


def stale_days(df: DataFrame, date: str, code: str, least_share: float = 0.5) -> int:
    """Days between the table's last date and the one that most codes reach."""
    last = df.groupBy(code).agg(F.max(date).alias("_last"))
    days = last.select(F.unix_date(F.col("_last")).alias("d"))
    row = days.agg(F.max("d").alias("a"), F.expr(f"percentile_disc({1 - least_share}) WITHIN GROUP (ORDER BY d)").alias("b")).first()
    return int(row.a - row.b) if row.a is not None else 0


def update(name: str, stored: DataFrame | None, fetch: Callable[[dt.date, dt.date], DataFrame], first: dt.date, today: dt.date, calendar: DataFrame | None = None) -> DataFrame:
    """The table after an update: fetched from the overlap on, merged by the table's full key, lagging codes filled if a calendar is given.

    Only daily panels are filled: a row copied into an event table would be an event that never was.
    """
    table = TABLES[name]
    last = max_date(stored, table.date).first()[0] if stored is not None and table.date else None
    fetched = fetch(fetch_start(table, last, first), today)
    merged = fetched if stored is None else upsert(stored, fetched, list(table.keys))
    if calendar is not None and table.kind == "panel" and "stock_code" in table.keys:
        merged = backfill(merged, calendar, F.lit(today), code="stock_code", date=table.date)
    return merged


def ingest_periods(spark: SparkSession, folder: str, periods: dict[str, Callable[[], DataFrame]]) -> list[str]:
    """Fetch each period into a table of its own, those that are there whole left out; the periods fetched.

    A run that was cut off goes on with what is missing.
    """
    parts, done = Folder(spark, folder), []
    for name, fetch in periods.items():
        if not parts.complete(name):
            fetch().write.mode("overwrite").parquet(parts.at(name))
            done.append(name)
    return done


def consolidate(spark: SparkSession, folder: str, keys: list[str]) -> DataFrame:
    """The periods of a folder as one table: of rows with the same key, that of the last period."""
    parts = Folder(spark, folder)
    names = [n for n in parts.names() if parts.complete(n)]
    rows = None
    for i, n in enumerate(names):
        own = spark.read.parquet(parts.at(n)).withColumn("_period", F.lit(i))
        rows = own if rows is None else rows.unionByName(own, allowMissingColumns=True)
    if rows is None:
        raise FileNotFoundError(f"no period is complete in {folder}")
    rest = [c for c in rows.columns if c not in (*keys, "_period")]
    row = F.struct(*rest) if rest else F.lit(None)
    last = rows.groupBy(*keys).agg(F.max_by(row, F.struct("_period", *rest)).alias("_row"))
    return last.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])


def ingest_all(
    spark: SparkSession,
    root: str,
    fetchers: dict[str, Callable[[dt.date, dt.date], DataFrame]],
    first: dt.date,
    today: dt.date,
    calendar: DataFrame | None = None,
    only_missing: bool = False,
    dry_run: bool = False,
) -> dict[str, str]:
    """Bring every registered table that has a fetcher up to date; what was done by name, failures included.

    ``only_missing`` leaves tables alone that are there. A table is written beside
    and then takes the old one's place, and one that fails does not stop the rest.
    """
    base, done = Folder(spark, root), {}
    for name, table in TABLES.items():
        if name not in fetchers:
            continue
        there = base.complete(f"{name}.parquet")
        if there and only_missing:
            done[name] = "skipped"
            continue
        stored = spark.read.parquet(base.at(f"{name}.parquet")) if there else None
        if dry_run:
            last = max_date(stored, table.date).first()[0] if stored is not None and table.date else None
            done[name] = f"from {fetch_start(table, last, first)}"
            continue
        try:
            beside = f"{name}.parquet.new"
            update(name, stored, fetchers[name], first, today, calendar).write.mode("overwrite").parquet(base.at(beside))
            if there:
                base.move(f"{name}.parquet", f"{name}.parquet.old")
            base.move(beside, f"{name}.parquet")
            base.remove(f"{name}.parquet.old")
            done[name] = "updated" if there else "created"
        except Exception as e:  # noqa: BLE001  reported by name
            done[name] = f"failed: {e}".splitlines()[0][:200]
    return done
