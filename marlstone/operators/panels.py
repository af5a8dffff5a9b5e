"""Keys, codes, universes and upserts of panels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Market suffixes that are removed from codes, and the length that codes are padded to.
SUFFIXES = ("SZ", "SH", "BJ", "BSE")
CODE_LENGTH = 6


def normalise_code(code: Column) -> Column:
    """Without market suffix, in any case, and padded with zeros; longer codes stay as they are."""
    bare = F.regexp_replace(F.trim(code.cast("string")), rf"(?i)\.({'|'.join(SUFFIXES)})$", "")
    return F.when(F.length(bare) < CODE_LENGTH, F.lpad(bare, CODE_LENGTH, "0")).otherwise(bare)


def date_key(date: Column) -> Column:
    """A date as YYYYMMDD."""
    return F.date_format(date, "yyyyMMdd")


def parse_date(text: Column) -> Column:
    """YYYY-MM-DD or YYYYMMDD as a date; anything else is NULL."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")), F.try_to_timestamp(text, F.lit("yyyyMMdd"))).cast("date")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Neither NaN nor infinity leaves a source."""
    bad = lambda c: F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return df.withColumns({c: F.when(~bad(c), F.col(c)) for c, kind in df.dtypes if kind in ("double", "float")})


def normalise_panel(df: DataFrame) -> DataFrame:
    """Keys found by name and put in one form: date (DATE), code (text); helper names dropped, NaN to NULL."""
    for date, code in (("trade_date", "stock_code"), ("date", "code"), ("Date", "Code")):
        if date in df.columns and code in df.columns:
            break
    else:
        raise ValueError(f"no date and code columns in {df.columns}")
    rest = [c for c in df.columns if c not in (date, code, "name", "stock_name")]
    day = F.col(date) if df.schema[date].dataType.typeName() in ("date", "timestamp") else parse_date(F.col(date))
    return nan_to_null(df.select(day.cast("date").alias("date"), normalise_code(F.col(code)).alias("code"), *rest))


def in_pool(df: DataFrame, pool: DataFrame, code: str = "code") -> DataFrame:
    """Rows whose code is in the pool; all rows if the pool is empty."""
    empty = pool.agg((F.count(code) == 0).alias("_open"))
    marked = df.join(pool.select(F.col(code).alias("_code")).distinct(), F.col(code) == F.col("_code"), "left")
    return marked.join(F.broadcast(empty), F.lit(True)).where(F.col("_open") | F.col("_code").isNotNull()).drop("_open", "_code")  # empty: one row


def date_slice(df: DataFrame, start: Column | None = None, end: Column | None = None, lookback_days: int = 0, date: str = "date") -> DataFrame:
    """Rows from ``lookback_days`` before ``start`` up to ``end``; the filter reaches the scan."""
    if start is not None:
        df = df.where(F.col(date) >= F.date_sub(start, lookback_days))
    return df if end is None else df.where(F.col(date) <= end)


def unique_by_key(df: DataFrame, values: list[str], keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    """One row per key, with each column's largest value, where a table may list a key more than once."""
    return df.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values])


def duplicate_keys(df: DataFrame, keys: tuple[str, ...] = ("date", "code")) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], strict: bool = True) -> DataFrame:
    """All rows of both; of rows with the same key the new one. Not strict: only whole rows that are equal are one."""
    both = base.withColumn("_source", F.lit(0)).unionByName(new.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    if not strict:
        return both.drop("_source").dropDuplicates()
    rest = [c for c in both.columns if c not in keys]
    newest = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("_source", *[c for c in rest if c != "_source"])).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest if c != "_source"])


def backfill(df: DataFrame, calendar: DataFrame, today: Column, code: str = "code", date: str = "date", calendar_date: str = "date") -> DataFrame:
    """``df`` and, for codes whose last row is before ``today``, that row again on each later open day, marked is_backfill.

    Only open days after the latest of those last rows and up to ``today`` are filled.
    """
    marked = df.withColumn("is_backfill", F.coalesce("is_backfill", F.lit(False)) if "is_backfill" in df.columns else F.lit(False))
    last = marked.groupBy(code).agg(F.max(date).alias("_last")).where(F.col("_last") < today)
    latest = last.agg(F.max("_last").alias("_latest"))  # one row
    days = calendar.where("is_open = 1").select(F.col(calendar_date).alias("_day")).distinct().join(F.broadcast(latest), (F.col("_day") > F.col("_latest")) & (F.col("_day") <= today)).select("_day")
    spread = days.agg(F.collect_set("_day").alias("_days"))  # one row; the days since the latest stale date
    stale = marked.join(last, code).where(F.col(date) == F.col("_last")).join(F.broadcast(spread), F.lit(True))
    filled = stale.withColumn(date, F.explode("_days")).withColumn("is_backfill", F.lit(True))
    return marked.unionByName(filled.select(marked.columns))


def freshness(tables: dict[str, DataFrame], end: Column, date: str = "date") -> DataFrame:
    """(name, last_date, status): ok, stale, future or empty, against the date that data should reach."""
    each = [df.agg(F.max(date).alias("last_date")).select(F.lit(name).alias("name"), "last_date") for name, df in tables.items()]
    status = F.when(F.col("last_date").isNull(), "empty").when(F.col("last_date") > end, "future").when(F.col("last_date") < end, "stale").otherwise("ok")
    return reduce(DataFrame.unionByName, each).withColumn("status", status)


def manifests(values: DataFrame, value: str = "value", key: str = "factor") -> DataFrame:
    """The same for every signal of a long table: a row for each key."""
    days = values.groupBy(key, "date").agg(F.count(value).alias("n"))
    last = days.groupBy(F.col(key).alias("_key")).agg(F.max("date").alias("last_date"), F.max_by("n", "date").alias("last_day_codes"), F.count("*").alias("rows"), F.sum("n").alias("non_null_cells"))
    cols = values.groupBy(key).agg(F.countDistinct("code").alias("cols"))
    joined = cols.join(last, F.col(key) == F.col("_key")).drop("_key")
    return joined.withColumn("coverage_ratio", F.try_divide(F.col("non_null_cells"), F.col("rows") * F.col("cols")))


def manifest(values: DataFrame, value: str = "value") -> DataFrame:
    """One row about a signal: dates, codes, values, their share of the grid, the last date and its values."""
    last = values.groupBy("date").agg(F.count(value).alias("n")).agg(F.max("date").alias("last_date"), F.max_by("n", "date").alias("last_day_codes"))
    whole = values.agg(F.countDistinct("date").alias("rows"), F.countDistinct("code").alias("cols"), F.count(value).alias("non_null_cells"))
    joined = whole.join(F.broadcast(last), F.lit(True))  # one row each
    return joined.withColumn("coverage_ratio", F.try_divide(F.col("non_null_cells"), F.col("rows") * F.col("cols")))
