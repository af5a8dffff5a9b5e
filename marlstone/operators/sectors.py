"""Sector series and their averages over the sectors that a code belongs to.

``bridge`` is (code, sector), many to many; ``series`` is (date, sector, ...).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.signal import Sig, average_rank, col, lag, with_signals


def sector_grid(series: DataFrame) -> DataFrame:
    """(date, sector, close) on all dates of all sectors, so that row offsets mean dates."""
    dates, sectors = series.select("date").distinct(), series.select("sector").distinct()
    grid = dates.join(sectors, F.lit(True), "inner")  # sectors are a few hundred
    return grid.join(series.groupBy("date", "sector").agg(F.max("close").alias("close")), ["date", "sector"], "left")


def sector_signals(series: DataFrame, signals: dict[str, Sig]) -> DataFrame:
    """(date, sector, signals) over the grid, offsets within a sector."""
    return with_signals(sector_grid(series), signals, code="sector").select("date", "sector", *signals)


def sector_average(values: DataFrame, bridge: DataFrame, column: str) -> DataFrame:
    """(date, code, column): the mean over the code's sectors, NULLs skipped; no row without any."""
    joined = bridge.select("code", "sector").distinct().join(values.where(F.col(column).isNotNull()).select("date", "sector", column), "sector")
    return joined.groupBy("date", "code").agg(F.avg(column).alias(column))


def member_ranks(values: DataFrame, bridge: DataFrame, sectors: DataFrame, column: str, least: int = 3) -> DataFrame:
    """(date, code, mean_rank): the mean of the code's percentile ranks within its sectors.

    Sectors that have no series, or fewer than ``least`` members among the codes
    with values, are left out; if none is left, the plain value stands in.
    """
    known = values.select("code").distinct()
    members = bridge.select("code", "sector").distinct().join(sectors.select("sector").distinct(), "sector", "left_semi").join(known, "code", "left_semi")
    large = members.groupBy("sector").count().where(F.col("count") >= least).select("sector")
    members = members.join(large, "sector", "left_semi")
    w = Window.partitionBy("date", "sector").orderBy(F.col(column).asc_nulls_last())
    ranked = values.where(F.col(column).isNotNull()).select("date", "code", column).join(members, "code")
    share = average_rank(F.col(column), w) / F.count(column).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    mean = ranked.withColumn("_r", share).groupBy("date", "code").agg(F.avg("_r").alias("mean_rank"))
    none = large.agg((F.count("*") == 0).alias("_none"))  # one row
    plain = values.join(F.broadcast(none), F.lit(True)).where("_none").select("date", "code", F.col(column).alias("mean_rank"))
    return mean.unionByName(plain)


def rank_moves(series: DataFrame, rows: int = 20) -> DataFrame:
    """(date, sector, rank_move): how far a sector's rank by its change lies from the rank of the change ``rows`` before."""
    change = col("close") / lag(col("close"), rows) - 1
    from marlstone.functions.signal import absolute, pct_rank

    return sector_signals(series, {"rank_move": absolute(pct_rank(change) - pct_rank(lag(change, rows)))})


def sector_counts(panel: DataFrame, bridge: DataFrame) -> DataFrame:
    """(date, code, sectors): on every date of the panel, for each of its codes, the number of its sectors."""
    n = bridge.groupBy("code").agg(F.countDistinct("sector").cast("double").alias("sectors"))
    codes = panel.select("code").distinct().join(n, "code", "left").select("code", F.coalesce("sectors", F.lit(0.0)).alias("sectors"))
    return panel.select("date").distinct().join(codes, F.lit(True), "inner")
