"""Model inputs and outputs: training matrices, normalisation, splits, losses, portfolios and ensembles."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.signal import quantised

MONEY = 1.5e9
TOP = 500


def training_matrix(factors: DataFrame, names: list[str], universe: DataFrame | None = None) -> DataFrame:
    """(date, code, one column per factor) of every key that any factor has."""
    rows = factors if universe is None else factors.join(universe.select("code").distinct(), "code", "left_semi")
    return rows.where(F.col("factor").isin(names)).groupBy("date", "code").pivot("factor", names).agg(F.max("value"))


def training_panel(factors: DataFrame, labels: DataFrame, names: list[str]) -> DataFrame:
    """The matrix on all label dates and codes of the labels, factors that end before the labels carried forward.

    Rows without any factor are left out.
    """
    dates, codes = labels.select("date").distinct(), labels.select("code").distinct()
    grid = dates.join(codes, F.lit(True), "inner")  # the grid is what is asked for
    wide = grid.join(training_matrix(factors, names), ["date", "code"], "left")
    # one row: does each factor end before the labels do?
    ends = factors.agg(*[F.max(F.when(F.col("factor") == n, F.col("date"))).alias(f"_end_{n}") for n in names])
    late = labels.agg(F.max("date").alias("_end")).join(ends, F.lit(True)).select(*[(F.col(f"_end_{n}") < F.col("_end")).alias(f"_late_{n}") for n in names])
    w = Window.partitionBy("code").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    marked = wide.join(F.broadcast(late), F.lit(True))
    filled = marked.select("date", "code", *[F.when(F.col(f"_late_{n}"), F.last(n, ignorenulls=True).over(w)).otherwise(F.col(n)).alias(n) for n in names])
    return filled.where(F.coalesce(*[F.col(n) for n in names]).isNotNull())


def used_columns(df: DataFrame, names: list[str]) -> list[str]:
    """Names of columns with a value other than zero."""
    row = df.agg(*[F.max(F.abs(F.coalesce(F.col(n), F.lit(0.0)))).alias(n) for n in names]).first()
    return [n for n in names if (row[n] or 0) > 0]


def winsor_zscore(df: DataFrame, names: list[str], lower: float = 0.005, upper: float = 0.995, least_share: float = 0.1) -> DataFrame:
    """(date, code, names): per date clipped to two quantiles and standardised; missing and undefined become zero.

    Rows with fewer than a tenth of their factors, one at least, are left out before.
    """
    known = reduce(lambda a, b: a + b, [F.col(n).isNotNull().cast("int") for n in names])
    rows = df.where(known >= max(1, int(least_share * len(names))))
    w = Window.partitionBy("date")
    q = {f"_q{i}": F.percentile(F.col(n), F.array(F.lit(lower), F.lit(upper))).over(w) for i, n in enumerate(names)}
    rows = rows.withColumns(q)
    rows = rows.withColumns({n: F.when(F.col(n).isNotNull(), quantised(F.least(F.greatest(F.col(n), F.col(f"_q{i}")[0]), F.col(f"_q{i}")[1]))) for i, n in enumerate(names)}).drop(*q)
    z = lambda n: F.try_divide(F.col(n) - F.avg(n).over(w), F.nullif(F.stddev_samp(n).over(w), F.lit(0.0)))
    return rows.select("date", "code", *[F.coalesce(z(n), F.lit(0.0)).alias(n) for n in names])


def rank_weighted_corr(df: DataFrame) -> DataFrame:
    """(date, wpcc) of (date, code, pred, y), weights halving from the best prediction to the worst.

    The covariance is about weighted means, the second moments about plain ones.
    """
    w = Window.partitionBy("date")
    n = F.count("*").over(w)
    place = F.row_number().over(w.orderBy(F.desc("pred"), "code")) - 1
    weight = F.when(n > 1, F.pow(F.lit(0.5), place / (n - 1))).otherwise(1.0)
    rows = df.where("pred IS NOT NULL AND y IS NOT NULL").select("date", "pred", "y", weight.alias("k"), F.avg("pred").over(w).alias("pm"), F.avg("y").over(w).alias("ym"))
    s = lambda x: F.sum(x * F.col("k")) / F.sum("k")
    pred, y = F.col("pred"), F.col("y")
    return rows.groupBy("date").agg(
        ((s(pred * y) - s(pred) * s(y)) / (F.sqrt(s((pred - F.col("pm")) * (pred - F.col("pm")))) * F.sqrt(s((y - F.col("ym")) * (y - F.col("ym")))) + 1e-12)).alias("wpcc")
    )


def top_portfolio(df: DataFrame, top: int = TOP, money: float = MONEY) -> DataFrame:
    """(date, held, spent, ret) of (date, code, score, liquidity, ret): the best by score, each up to its liquidity, until the money is spent."""
    w = Window.partitionBy("date").orderBy(F.desc("score"), "code")
    best = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top)
    before = F.coalesce(F.sum("liquidity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.lit(money) - before
    hold = F.when(left >= 1, F.greatest(F.least(left, F.col("liquidity")), F.lit(0.0))).otherwise(0.0)
    return best.withColumn("_hold", hold).groupBy("date").agg(
        F.sum((F.col("_hold") > 0).cast("int")).alias("held"), F.sum("_hold").alias("spent"), (F.sum(F.col("ret") * F.col("_hold")) / money).alias("ret")
    )


def fold_ensemble(df: DataFrame, folds: int) -> DataFrame:
    """(date, code, value) of (date, code, fold, value): each fold standardised per date, then summed; a code that a fold lacks has none."""
    w = Window.partitionBy("date", "fold")
    z = F.try_divide(F.col("value") - F.avg("value").over(w), F.nullif(F.stddev_samp("value").over(w), F.lit(0.0)))
    return df.withColumn("_z", z).groupBy("date", "code").agg(F.when(F.count("_z") == folds, F.sum("_z")).alias("value"))


def unscored_dates(dates: DataFrame, scored: DataFrame) -> DataFrame:
    """Dates after the last one that has a prediction."""
    last = scored.agg(F.max("date").alias("_last"))
    return dates.select("date").distinct().join(F.broadcast(last), F.col("_last").isNull() | (F.col("date") > F.col("_last"))).select("date")  # last: one row


#: Dates kept out of training, and the days that the season before takes over from the one that they lie in.
EXCLUDED = (dt.date(2024, 2, 1), dt.date(2024, 2, 23))
SHIFTED = (dt.date(2024, 10, 1), dt.date(2024, 10, 16))
SHIFT_FROM, SHIFT_TO = "2024q4", "2024q3"


def _months(day: dt.date, n: int) -> dt.date:
    m = day.year * 12 + day.month - 1 + n
    return dt.date(m // 12, m % 12 + 1, 1)


def season_split(dates: DataFrame, season: str, period: int, folds: int = 4, purge: int = 10, months: int = 24) -> DataFrame:
    """(date, part) with part train, valid or test, for a quarter such as 2024q3 and the period-th validation block.

    The training span is the months before the quarter; it is cut into blocks of
    equal calendar length, the last up to the quarter. So many dates as ``purge``
    are left out at the validation block's end, at the end of what is trained on
    before it, and at both ends of what is trained on after it.
    """
    test_start = dt.date(int(season[:4]), 3 * int(season[5:]) - 2, 1)
    test_end, start = _months(test_start, 3), _months(test_start, -months)
    step = dt.timedelta(days=(test_start - start).days // folds)
    edges = [start + i * step for i in range(folds)] + [test_start]
    valid_start, valid_end = edges[period - 1], edges[period]
    d = F.col("date")
    between = lambda a, b: (d >= F.lit(a)) & (d < F.lit(b))
    shifted = d.between(F.lit(SHIFTED[0]), F.lit(SHIFTED[1]))
    parts = F.when(between(start, valid_start), "before").when(between(valid_start, valid_end), "valid").when(between(valid_end, test_start), "after").when(between(test_start, test_end), "test")
    days = dates.select("date").distinct().withColumn("_part", parts)
    w = Window.partitionBy("_part")
    days = days.withColumns({"_up": F.row_number().over(w.orderBy("date")), "_down": F.row_number().over(w.orderBy(F.desc("date")))})
    keep = (
        F.when(F.col("_part").isin("before", "valid"), F.col("_down") > purge)
        .when(F.col("_part") == "after", (F.col("_up") > purge) & (F.col("_down") > purge))
        .when(F.col("_part") == "test", F.lit(True) if season != SHIFT_FROM else d > F.lit(SHIFTED[1]))
    )
    part = F.when(F.col("_part").isin("before", "after"), "train").otherwise(F.col("_part"))
    out = days.where(keep).select("date", part.alias("part"))
    out = out.where((F.col("part") != "train") | ~d.between(F.lit(EXCLUDED[0]), F.lit(EXCLUDED[1])))
    if season in (SHIFT_FROM, SHIFT_TO):
        out = out.unionByName(days.where(shifted).select("date", F.lit("test" if season == SHIFT_TO else "train").alias("part")))
    return out


def shuffled_split(dates: DataFrame, period: int, folds: int = 4, seed: int = 42) -> DataFrame:
    """(date, part): dates dealt to folds by a seeded hash; one fold is for validation."""
    fold = F.pmod(F.xxhash64(F.lit(seed), F.col("date").cast("string")), F.lit(folds)) + 1
    return dates.select("date").distinct().select("date", F.when(fold == period, "valid").otherwise("train").alias("part"))


def validation_score(returns: Column, ic: Column) -> Column:
    """What the best checkpoint is picked by."""
    return 100 * returns + 0.7 * ic
