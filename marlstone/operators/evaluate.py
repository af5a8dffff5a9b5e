"""Information coefficients: how a signal's cross section goes with a label's."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.signal import average_rank

LEAST_PAIRS = 10


def ic_series(factors: DataFrame, labels: DataFrame, method: str = "spearman", least: int = LEAST_PAIRS) -> DataFrame:
    """(factor, target, date, pairs, ic) for all factors and targets at once.

    factors: (factor, date, code, value); labels: (target, date, code, value).
    Dates with fewer than ``least`` pairs are left out. Spearman is Pearson of
    average ranks among the pairs.
    """
    x = factors.where(F.col("value").isNotNull()).select("factor", "date", "code", F.col("value").alias("x"))
    y = labels.where(F.col("value").isNotNull()).select("target", "date", "code", F.col("value").alias("y"))
    return _coefficients(x.join(y, ["date", "code"]), method, least)


def _coefficients(pairs: DataFrame, method: str, least: int) -> DataFrame:
    if method == "spearman":
        keys = ("factor", "target", "date")
        pairs = pairs.withColumn("x", average_rank(F.col("x"), Window.partitionBy(*keys).orderBy("x"))).withColumn("y", average_rank(F.col("y"), Window.partitionBy(*keys).orderBy("y")))
    elif method != "pearson":
        raise ValueError(f"method {method!r}: spearman or pearson")
    return pairs.groupBy("factor", "target", "date").agg(F.count("*").alias("pairs"), F.corr("x", "y").alias("ic")).where(F.col("pairs") >= least)


def ic_of(values: DataFrame, factors: list[str], targets: list[str], method: str = "spearman", least: int = LEAST_PAIRS) -> DataFrame:
    """The same of one table (factor, date, code, value) that holds factors and labels: read once, and paired within a key instead of joined."""
    wide = values.groupBy("date", "code").pivot("factor", [*factors, *targets]).agg(F.max("value"))
    pair = lambda f, t: F.struct(F.lit(f).alias("factor"), F.lit(t).alias("target"), F.col(f).alias("x"), F.col(t).alias("y"))
    pairs = wide.select("date", "code", F.inline(F.array(*[pair(f, t) for f in factors for t in targets]))).where("x IS NOT NULL AND y IS NOT NULL")
    return _coefficients(pairs, method, least)


def ic_summary(series: DataFrame) -> DataFrame:
    """(factor, target, dates, mean, std, icir, positive_share, t_stat); dates without an ic do not count."""
    known = series.where(F.col("ic").isNotNull() & ~F.isnan("ic"))
    base = known.groupBy("factor", "target").agg(F.count("*").alias("dates"), F.avg("ic").alias("mean"), F.stddev_samp("ic").alias("std"), F.avg((F.col("ic") > 0).cast("double")).alias("positive_share"))
    ir = F.try_divide(F.col("mean"), F.nullif(F.col("std"), F.lit(0.0)))
    return base.withColumn("icir", ir).withColumn("t_stat", ir * F.sqrt("dates"))


def ic_matrix(series: DataFrame, targets: list[str]) -> DataFrame:
    """One row per factor with the mean ic of each target."""
    return series.groupBy("factor").pivot("target", targets).agg(F.avg("ic"))
