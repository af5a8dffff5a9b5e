"""Queries of sources, sinks, planning and ingest: what they write goes to the shared folder and is read from there."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.factors import all_factors, get_factor, ordered_names
from marlstone.factors.registry import CATEGORY_ORDER
from marlstone.operators import model
from marlstone.operators.panels import date_key, normalise_panel
from marlstone.plans import ingest, planner, store
from marlstone.plans.build import build, compute
from marlstone.sources import feather, paged, sample_sql as S, tables
from marlstone.sources.catalog import ParquetCatalog
from marlstone.sources.files import Folder
from marlstone.sources.sample import SampleCatalog
from marlstone.sources.sample_sql import factor_sql
from marlstone.sources.shipping import ship_package
from marlstone.streaming.upserts import shared_folder

Query = Callable[[SparkSession, str], DataFrame]
CUT, OVERLAP = dt.date(2000, 1, 3), dt.date(1999, 11, 1)
EXCHANGED = ("bp", "mom_20")
STORED = ("mom_5", "bias_20")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars as a source writes them: text dates, codes with a market."""
    bars = SampleCatalog(spark, sf_dir).panel("daily_adj")
    return bars.select(
        F.col("date").cast("string").alias("trade_date"), F.concat(F.lpad(F.col("code").cast("string"), 6, "0"), F.lit(".SZ")).alias("stock_code"), F.lit("n").alias("stock_name"), "open", "high", "low", "close", "vol", "amount", "pct_chg"
    )


def _written(spark: SparkSession, sf_dir: str) -> str:
    folder = shared_folder(spark)
    _bars(spark, sf_dir).write.parquet(f"{folder}/daily_adj.parquet")
    return folder


def parquet_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A factor from source files instead of the sample's views."""
    out = compute(ParquetCatalog(spark, _written(spark, sf_dir)), "mom_20")
    return out.select(date_key(F.col("date")).alias("date"), "code", "value")


def pruned_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an incremental build reads: bars from a date on, by a filter that reaches the scan."""
    panel = ParquetCatalog(spark, _written(spark, sf_dir)).since(CUT).panel("daily_adj")
    return panel.select(date_key(F.col("date")).alias("date"), "code", "close")


def whitelist_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the codes that a text file lists."""
    folder = _written(spark, sf_dir)
    listed = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_suppkey").cast("string").alias("value"))
    listed.write.text(f"{folder}/pool")
    panel = ParquetCatalog(spark, folder, tables.load_pool(spark, f"{folder}/pool")).panel("daily_adj")
    return panel.select(date_key(F.col("date")).alias("date"), "code", "close")


def rename_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalise_panel(_bars(spark, sf_dir))
    return out.select(date_key(F.col("date")).alias("date"), "code", *[c for c in out.columns if c not in ("date", "code", "pct_chg")])


def regex_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    raw = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lpad(key, 6, "0"), F.lit(".SH"))).when(F.col("s_suppkey") % 3 == 1, F.concat(key, F.lit(".SZ"))).otherwise(F.concat(F.lpad(key, 6, "0"), F.lit(".BSE")))
    return tables.clean_codes(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", raw.alias("stock_code")))


def metadata_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date of rows that were not filled in."""
    bars = _bars(spark, sf_dir).withColumn("is_backfill", F.when(F.col("trade_date") > F.lit(CUT), F.lit(True)))
    return tables.max_date(bars, "trade_date")


def used_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the columns that are not zero throughout."""
    bars = SampleCatalog(spark, sf_dir).panel("daily_adj").select("close", "vol", (F.col("vol") * 0).alias("zero"), F.lit(None).cast("double").alias("missing"))
    return spark.createDataFrame([(n,) for n in model.used_columns(bars, bars.columns)], "name string")


def feather_exchange(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors written as wide files, dates by codes, and read again."""
    folder = shared_folder(spark)
    values = build(SampleCatalog(spark, sf_dir), list(EXCHANGED)).withColumn("date", date_key(F.col("date")))
    feather.write_factors(values, folder)
    return feather.read_factors(spark, f"{folder}/*.feather")


def store_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors stored up to a date, then brought up to date with an overlap, all in one write each."""
    values = build(SampleCatalog(spark, sf_dir), list(STORED))
    at = store.FactorStore(spark, shared_folder(spark))
    at.write_all(values.where(F.col("date") < F.lit(CUT)).withColumn("value", F.when(F.col("date") < F.lit(OVERLAP), F.col("value"))), list(STORED))
    at.add_all(values.where(F.col("date") >= F.lit(OVERLAP)), list(STORED))
    return at.load(STORED[0]).select(date_key(F.col("date")).alias("date"), "code", "value")


def store_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifests that the store keeps of several factors."""
    at = store.FactorStore(spark, shared_folder(spark))
    values = build(SampleCatalog(spark, sf_dir), list(STORED))
    infos = at.write_all(values, list(STORED))
    rows = [(n, i["rows"], i["cols"], i["non_null_cells"], i["last_date"], i["last_day_codes"], i["version"]) for n, i in infos.items()]
    return spark.createDataFrame(rows, "name string, rows long, cols long, non_null_cells long, last_date string, last_day_codes long, version long")


def prediction_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions by date; dates written again are replaced."""
    path = f"{shared_folder(spark)}/predictions"
    scores = compute(SampleCatalog(spark, sf_dir), "mom_20").where("value IS NOT NULL").select(date_key(F.col("date")).alias("date"), "code", F.col("value").alias("score"))
    late = F.col("date") >= f"{CUT:%Y%m%d}"
    store.save_predictions(scores, path)
    store.save_predictions(scores.where(late).withColumn("score", F.col("score") + 1), path)
    return spark.read.schema("code long, score double, date string").parquet(path).select("date", "code", "score")


#: States to decide about: name, the date that is built, the dates of two sources.
STATES = (
    ("fresh", "2024-01-10", "2024-01-10", "2024-01-12"),
    ("stale", "2024-01-05", "2024-01-10", "2024-01-12"),
    ("new", None, "2024-01-10", "2024-01-12"),
    ("ahead", "2024-02-01", "2024-01-10", "2024-01-12"),
    ("unknown", "2024-01-05", None, "2024-01-12"),
)
LAST_BAR, NOW = dt.date(2024, 1, 31), dt.datetime(2024, 1, 20, 9)


def build_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the planner decides, and from which date."""
    day = lambda x: dt.date.fromisoformat(x) if x else None
    end = planner.effective_end(LAST_BAR, NOW)
    made = [(n, planner.decide(day(b), {"a": day(x), "b": day(y)}, end)) for n, b, x, y in STATES]
    return spark.createDataFrame([(n, d.action, str(d.start) if d.start else None, str(end)) for n, d in made], "name string, action string, start string, effective_end string")


def category_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ordered_names(), 1)), "place long, name string")


def _pages(spark: SparkSession, **options: str) -> DataFrame:
    ship_package(spark)
    spark.dataSource.register(paged.PagedSource)
    every = {"fetch": "marlstone.sources.sample_pages:fetch", "page_rows": "7", "per_minute": "1000000"}
    return spark.read.format("paged").options(**(every | options)).schema("day string, code string, k int, v double").load()


def paged_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month by month; too large a month in halves."""
    return _pages(spark, start="2024-01-10", end="2024-03-05", range_rows="40")


def paged_months_unsplit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, start="2024-01-10", end="2024-03-05", range_rows="40", split="false")


def paged_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open days of a calendar."""
    days = SampleCatalog(spark, sf_dir).table("calendar").where("is_open = 1 AND date BETWEEN '1999-01-01' AND '1999-01-31'").select(F.col("date").cast("string")).collect()
    return _pages(spark, by="days", dates=",".join(r[0] for r in days), start="1999-01-05")


def paged_quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, by="quarters", start="2023-06-30", end="2024-04-01")


def paged_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each code over the whole span."""
    codes = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_suppkey < 5").select(F.lpad(F.col("s_suppkey").cast("string"), 6, "0").alias("c")).collect()
    return _pages(spark, by="codes", codes=",".join(r.c for r in codes), start="2024-01-01", end="2024-01-09", concurrency="2")


def paged_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, by="once")


def resumed_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping periods fetched into tables of their own by a run that is cut off and one that goes on, then made one."""
    folder, bars = shared_folder(spark), _bars(spark, sf_dir).select("trade_date", "stock_code", "close")
    between = lambda a, b, plus: lambda: bars.where(F.col("trade_date").between(a, b)).withColumn("close", F.col("close") + plus)
    periods = {"p1": between("1998-01-01", "1998-06-30", 0), "p2": between("1998-06-01", "1998-12-31", 1), "p3": between("1998-12-01", "1999-03-31", 2)}
    ingest.ingest_periods(spark, folder, {"p1": periods["p1"]})
    bars.limit(1).write.parquet(f"{folder}/p2")
    Folder(spark, folder).remove("p2/_SUCCESS")  # as a run that was cut off leaves it
    if ingest.ingest_periods(spark, folder, periods) != ["p2", "p3"]:
        raise AssertionError("a whole period was fetched again")
    return ingest.consolidate(spark, folder, ["trade_date", "stock_code"])


def ingest_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All registered tables that have a fetcher: made, left alone where there, and brought up to date."""
    root, bars = shared_folder(spark), _bars(spark, sf_dir).select("trade_date", "stock_code", "close").withColumn("trade_date", F.to_date("trade_date"))
    fetch = lambda a, b: bars.where(F.col("trade_date").between(F.lit(a), F.lit(b)))
    again = lambda a, b: fetch(a, b).withColumn("close", F.col("close") + 1)
    first, last = dt.date(1990, 1, 1), dt.date(2010, 1, 1)
    ingest.ingest_all(spark, root, {"daily": fetch, "daily_adj": fetch}, first, CUT)
    ingest.ingest_all(spark, root, {"daily": again}, first, last, only_missing=True)
    ingest.ingest_all(spark, root, {"daily_adj": again}, first, last)
    each = [spark.read.parquet(f"{root}/{n}.parquet").select(F.lit(n).alias("name"), date_key(F.col("trade_date")).alias("date"), "stock_code", "close") for n in ("daily", "daily_adj")]
    return each[0].unionByName(each[1])


QUERIES: tuple[Query, ...] = (
    parquet_catalog, pruned_catalog, whitelist_scan, rename_drop, regex_filter, metadata_probe, used_columns, feather_exchange, store_incremental, store_manifest, prediction_sink,
    build_plan, category_order, paged_months, paged_months_unsplit, paged_days, paged_quarters, paged_codes, paged_snapshot, resumed_ingest, ingest_tables,
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in QUERIES}


def oracles() -> dict[str, str]:
    bars = S.panel("daily_adj")
    of = lambda n: factor_sql(get_factor(n))
    code, key = "lpad(CAST(code AS VARCHAR), 6, '0') AS code", "strftime(date, '%Y%m%d') AS date"
    pages = lambda days, code="'000000'": (
        f"SELECT strftime(d, '%Y-%m-%d') AS day, {code} AS code, CAST(k AS INTEGER) AS k, CAST(date_diff('day', DATE '2024-01-01', CAST(d AS DATE)) * 10 + k AS DOUBLE) AS v FROM ({days}), (SELECT unnest(range(3)) AS k)"
    )
    span = lambda a, b: f"SELECT unnest(generate_series(TIMESTAMP '{a}', TIMESTAMP '{b}', INTERVAL 1 DAY)) AS d"
    months = pages(span("2024-01-10", "2024-03-05"))
    states = ", ".join(f"({', '.join('NULL' if x is None else repr(x) for x in row)})" for row in STATES)
    rank = "CASE category " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORY_ORDER)) + f" ELSE {len(CATEGORY_ORDER)} END"
    named = ", ".join(f"('{s.name}', '{s.category}')" for s in all_factors().values())
    facts = lambda n: (
        f"SELECT '{n}' AS name, count(DISTINCT date) AS rows, count(DISTINCT code) AS cols, count(value) AS non_null_cells, "
        f"CAST(strptime(max(date), '%Y%m%d') AS DATE)::VARCHAR AS last_date, count(value) FILTER (WHERE date = (SELECT max(date) FROM ({of(n)}))) AS last_day_codes, CAST(1 AS BIGINT) AS version FROM ({of(n)})"
    )
    stock = "lpad(CAST(code AS VARCHAR), 6, '0') || '.SZ' AS stock_code"
    period = lambda a, b, plus: f"SELECT strftime(date, '%Y-%m-%d') AS trade_date, {stock}, close + {plus} AS close, {plus} AS p FROM ({bars}) WHERE date BETWEEN DATE '{a}' AND DATE '{b}'"
    overlap = f"(SELECT max(date) FROM ({bars}) WHERE date <= DATE '{CUT}') - 3"
    return {
        "parquet_catalog": f"SELECT date, {code}, value FROM ({of('mom_20')})",
        "pruned_catalog": f"SELECT {key}, {code}, close FROM ({bars}) WHERE date >= DATE '{CUT}'",
        "whitelist_scan": f"SELECT {key}, {code}, close FROM ({bars}) WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
        "rename_drop": f"SELECT {key}, {code}, open, high, low, close, vol, amount FROM ({bars})",
        "regex_filter": "SELECT s_suppkey, k || '.SH' AS stock_code FROM (SELECT s_suppkey, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS k FROM supplier) WHERE s_suppkey % 3 = 0",
        "metadata_probe": f"SELECT strftime(max(date), '%Y-%m-%d') AS max_date FROM ({bars}) WHERE date <= DATE '{CUT}'",
        "used_columns": f"SELECT unnest(['close', 'vol']) AS name FROM (SELECT max(abs(close)) AS c, max(abs(vol)) AS v FROM ({bars})) WHERE c > 0 AND v > 0",
        "feather_exchange": " UNION ALL ".join(f"SELECT '{n}' AS factor, date, CAST(code AS VARCHAR) AS code, value FROM ({of(n)}) WHERE value IS NOT NULL" for n in EXCHANGED),
        "store_incremental": of(STORED[0]),
        "store_manifest": " UNION ALL ".join(map(facts, STORED)),
        "prediction_sink": f"SELECT date, code, CASE WHEN date >= '{CUT:%Y%m%d}' THEN value + 1 ELSE value END AS score FROM ({of('mom_20')}) WHERE value IS NOT NULL",
        "build_plan": (
            f"WITH s AS (SELECT * FROM (VALUES {states}) t(name, built, a, b)), e AS (SELECT least(DATE '{LAST_BAR}', DATE '{NOW.date()}' - 1) AS d), "
            "r AS (SELECT s.*, e.d, least(CAST(a AS DATE), CAST(b AS DATE), e.d) AS reach FROM s, e), "
            "x AS (SELECT *, CASE WHEN built IS NULL THEN 'rebuild' WHEN a IS NULL OR b IS NULL THEN 'skip' WHEN CAST(built AS DATE) > d THEN 'rebuild' WHEN CAST(built AS DATE) >= reach THEN 'skip' ELSE 'incremental' END AS action FROM r) "
            "SELECT name, action, CASE WHEN action = 'incremental' THEN CAST(CAST(built AS DATE) + 1 AS VARCHAR) END AS start, CAST(d AS VARCHAR) AS effective_end FROM x"
        ),
        "category_order": f"SELECT row_number() OVER (ORDER BY {rank}, category, name) AS place, name FROM (VALUES {named}) t(name, category)",
        "paged_months": months,
        "paged_months_unsplit": months,
        "paged_days": pages(f"SELECT d FROM ({span('1999-01-05', '1999-01-31')}) WHERE dayofweek(d) BETWEEN 1 AND 5"),
        "paged_quarters": pages("SELECT unnest([TIMESTAMP '2023-06-30', TIMESTAMP '2023-09-30', TIMESTAMP '2023-12-31', TIMESTAMP '2024-03-31']) AS d"),
        "paged_codes": pages(f"SELECT * FROM ({span('2024-01-01', '2024-01-09')}), (SELECT s_suppkey FROM supplier WHERE s_suppkey < 5)", "lpad(CAST(s_suppkey AS VARCHAR), 6, '0')"),
        "paged_snapshot": pages("SELECT TIMESTAMP '2024-01-01' AS d"),
        "resumed_ingest": (
            f"SELECT trade_date, stock_code, close FROM (SELECT *, row_number() OVER (PARTITION BY trade_date, stock_code ORDER BY p DESC) AS n FROM ({period('1998-01-01', '1998-06-30', 0)} "
            f"UNION ALL {period('1998-06-01', '1998-12-31', 1)} UNION ALL {period('1998-12-01', '1999-03-31', 2)})) WHERE n = 1"
        ),
        "ingest_tables": (
            f"SELECT 'daily' AS name, {key}, {stock}, close FROM ({bars}) WHERE date <= DATE '{CUT}' UNION ALL "
            f"SELECT 'daily_adj', {key}, {stock}, CASE WHEN date >= {overlap} THEN close + 1 ELSE close END FROM ({bars})"
        ),
    }
