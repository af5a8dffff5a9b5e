"""Queries over the driver's tables: every factor and operator, with the SQL to hold it against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone import source_queries
from marlstone.factors import all_factors, get_factor, ordered_names
from marlstone.functions.sqltext import quantised
from marlstone.operators import evaluate, model, panels
from marlstone.operators.asof import asof_panel
from marlstone.operators.panels import date_key
from marlstone.plans import store
from marlstone.plans.build import build, compute
from marlstone.sources import sample_sql as S
from marlstone.sources.sample import SampleCatalog
from marlstone.sources.sample_sql import factor_sql
from marlstone.streaming.upserts import shared_folder, stream_upsert

Query = Callable[[SparkSession, str], DataFrame]


def factor_query(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    out = compute(SampleCatalog(spark, sf_dir), name)
    return out.select(date_key(F.col("date")).alias("date"), "code", "value")


def factor_queries() -> dict[str, Query]:
    return {name: partial(factor_query, name) for name in all_factors()}


def factor_oracles() -> dict[str, str]:
    return {name: factor_sql(spec) for name, spec in all_factors().items()}


# ---- operators --------------------------------------------------------------

IC_FACTORS = ("mom_20", "reversal_5", "volatility_20", "volume_ratio_20")
IC_TARGETS = ("label_ret_1d", "label_ret_5d")
#: All factors and labels of the two largest panels.
FUSED = tuple(n for n in ordered_names() if get_factor(n).panel in ("daily_adj", "finance"))
ZSCORED = ("pb", "ps_ttm", "turnover_rate", "dv_ttm")
MONEY, TOP = 3e8, 40
SEASON, PERIOD = "1999q2", 2
CUTOVER, OVERLAP = "2000-01-01", "1999-11-01"


def _long(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """(factor, date, code, value) of several factors in one pass."""
    return _dated(build(SampleCatalog(spark, sf_dir), list(names)).select("factor", "date", "code", "value"))


def _long_sql(names: tuple[str, ...], key: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS {key}, * FROM ({factor_sql(get_factor(n))})" for n in names)


def _rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _dated(df: DataFrame) -> DataFrame:
    return df.withColumn("date", date_key(F.col("date")))


def asof_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = SampleCatalog(spark, sf_dir)
    return _dated(asof_panel(c.table("financial_indicator"), c.table("calendar"), ["roe", "q_eps", "gross_margin"]))


def _ic(method: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ic_of(_long(spark, sf_dir, IC_FACTORS + IC_TARGETS), list(IC_FACTORS), list(IC_TARGETS), method)


def ic_series_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ic("spearman", spark, sf_dir), "ic")


def ic_series_pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_ic("pearson", spark, sf_dir), "ic")


def ic_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.ic_summary(_ic("spearman", spark, sf_dir)), "mean", "std", "icir", "positive_share", "t_stat")


def ic_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(evaluate.ic_matrix(_ic("spearman", spark, sf_dir), list(IC_TARGETS)), *IC_TARGETS)


def winsor_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = model.winsor_zscore(SampleCatalog(spark, sf_dir).panel("finance"), list(ZSCORED))
    return _dated(_rounded(out, *ZSCORED))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = _dated(SampleCatalog(spark, sf_dir).panel("daily_adj").select("date", "code", F.col("amount").alias("liquidity")))
    score = factor_query("mom_20", spark, sf_dir).where("value IS NOT NULL").withColumnRenamed("value", "score")
    ret = factor_query("label_ret_5d", spark, sf_dir).where("value IS NOT NULL").withColumnRenamed("value", "ret")
    return score.join(ret, ["date", "code"]).join(amount, ["date", "code"])


def wpcc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir).select("date", "code", F.col("score").alias("pred"), F.col("ret").alias("y"))
    return _rounded(model.rank_weighted_corr(scored), "wpcc", digits=6)


def topk_portfolio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(model.top_portfolio(_scored(spark, sf_dir), TOP, MONEY), "spent", "ret")


def fold_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    folds = _long(spark, sf_dir, IC_FACTORS).where("value IS NOT NULL").withColumnRenamed("factor", "fold")
    return _rounded(model.fold_ensemble(folds, len(IC_FACTORS)), "value")


def season_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = SampleCatalog(spark, sf_dir).panel("daily_adj").select("date")
    return _dated(model.season_split(days, SEASON, PERIOD))


def _base_and_new(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = SampleCatalog(spark, sf_dir).panel("daily_adj").select("date", "code", "close", "vol")
    base = bars.where(F.col("date") < F.lit(CUTOVER).cast("date"))
    new = bars.where(F.col("date") >= F.lit(OVERLAP).cast("date")).withColumn("close", F.col("close") + 1)
    return base, new


def upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(panels.upsert(*_base_and_new(spark, sf_dir), ["date", "code"]))


def upsert_whole_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dated(panels.upsert(*_base_and_new(spark, sf_dir), ["date", "code"], strict=False))


def stream_upsert_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Upsert by a stream of files, a batch each: every micro-batch's counts are added by key to the stored table's.

    The stream is started anew for the second half of the files, as after a failure.
    """
    day, keys = F.col("ts").cast("date").alias("day"), ["day", "user_id"]
    counts = lambda df: df.groupBy(day, "user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_event"))
    add = lambda stored, new: stored.unionByName(new).groupBy(*keys).agg(F.sum("n").alias("n"), F.max("last_event").alias("last_event"))
    root, events = shared_folder(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    for half in (0, 1):
        events.where(F.pmod(F.col("event_id"), F.lit(2)) == half).repartition(2).write.mode("append").parquet(f"{root}/files")
        out = stream_upsert(spark, f"{root}/files", keys, counts, add, folder=root, files_per_batch=1)
    return out.withColumn("day", date_key(F.col("day")))


def backfill_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    days = events.groupBy(F.col("ts").cast("date").alias("date"), F.col("user_id").alias("code")).agg(F.count("*").alias("n"))
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    calendar = span.select(F.explode(F.sequence("a", "b")).alias("date")).withColumn("is_open", F.when(F.dayofweek("date").isin(1, 7), 0).otherwise(1))
    return _dated(panels.backfill(days, calendar, F.lit("2024-01-30").cast("date")))


def code_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    raw = (
        F.when(F.col("s_suppkey") % 5 == 0, key)
        .when(F.col("s_suppkey") % 5 == 1, F.concat(F.lit(" "), F.lpad(key, 6, "0"), F.lit(".SZ")))
        .when(F.col("s_suppkey") % 5 == 2, F.concat((F.col("s_suppkey") + 600000).cast("string"), F.lit(".sh")))
        .when(F.col("s_suppkey") % 5 == 3, F.concat((F.col("s_suppkey") + 920000).cast("string"), F.lit(".BJ")))
        .otherwise(F.concat(F.lit("1234567"), key, F.lit(".BSE")))
    )
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", panels.normalise_code(raw).alias("code"))


def pool_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = spark.read.parquet(f"{sf_dir}/supplier.parquet").where("s_acctbal > 5000").select(F.col("s_suppkey").alias("code"))
    return _dated(panels.in_pool(SampleCatalog(spark, sf_dir).panel("daily_adj").select("date", "code", "close"), pool))


def date_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = SampleCatalog(spark, sf_dir).panel("daily_adj").select("date", "code", "close")
    return _dated(panels.date_slice(bars, F.lit("1998-01-01").cast("date"), F.lit("1998-06-30").cast("date"), 30))


FRESH = ("daily_adj", "kline_adj_monthly", "finance", "limit_up")


def freshness_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = SampleCatalog(spark, sf_dir)
    out = panels.freshness({n: c.panel(n) for n in FRESH}, F.lit("2001-07-30").cast("date"))
    return out.withColumn("last_date", date_key(F.col("last_date")))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(panels.manifest(factor_query("mom_20", spark, sf_dir)), "coverage_ratio")


def training_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model.training_matrix(_long(spark, sf_dir, IC_FACTORS), list(IC_FACTORS))


def training_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With one factor that ends early, and so is carried forward."""
    factors = _long(spark, sf_dir, IC_FACTORS).where("factor <> 'reversal_5' OR date < '20010101'")
    return model.training_panel(factors, factor_query("label_ret_5d", spark, sf_dir), list(IC_FACTORS))


def fused_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = build(SampleCatalog(spark, sf_dir), list(FUSED))
    return _dated(out.select("factor", "date", "code", "value"))


def wide_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates by codes, as factor files are exchanged, of all codes; and back to a row for each cell that is filled, as columns that depend on the data cannot be held against SQL."""
    values = factor_query("bp", spark, sf_dir)
    codes = [r[0] for r in values.select("code").distinct().orderBy("code").collect()]  # the columns of the file, a universe of some thousand codes
    return store.from_wide(store.to_wide(values, codes))


def unscored_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    dates = _dated(SampleCatalog(spark, sf_dir).panel("daily_adj").select("date"))
    return model.unscored_dates(dates, factor_query("label_ret_20d", spark, sf_dir))


OPERATORS = (
    asof_quality, ic_series_rank, ic_series_pearson, ic_summary, ic_matrix, winsor_zscore, wpcc, topk_portfolio, fold_ensemble, season_split,
    upsert_keep_last, upsert_whole_rows, stream_upsert_keep_last, backfill_days, code_normalize, pool_filter, date_slice, freshness_report, manifest,
    training_matrix, training_panel, fused_build, wide_export, unscored_dates,
)


def operator_queries() -> dict[str, Query]:
    return {f.__name__: f for f in OPERATORS} | source_queries.queries()


def operator_oracles() -> dict[str, str]:
    """DuckDB SQL of each operator query, from the factors' SQL where it builds on factors."""
    bars, finance = S.panel("daily_adj"), S.panel("finance")
    of = lambda n: factor_sql(get_factor(n))
    key = "strftime(date, '%Y%m%d') AS date"

    rank = lambda c: f"rank() OVER (PARTITION BY factor, target, date ORDER BY {c}) + (count(*) OVER (PARTITION BY factor, target, date, {c}) - 1) / 2.0"
    pairs = (
        f"SELECT f.factor, l.target, date, f.value AS x, l.value AS y FROM ({_long_sql(IC_FACTORS, 'factor')}) f JOIN ({_long_sql(IC_TARGETS, 'target')}) l USING (date, code) "
        "WHERE f.value IS NOT NULL AND l.value IS NOT NULL"
    )
    ic = lambda p: f"SELECT factor, target, date, count(*) AS pairs, corr(x, y) AS ic FROM ({p}) GROUP BY ALL HAVING count(*) >= 10"
    spearman = ic(f"SELECT factor, target, date, {rank('x')} AS x, {rank('y')} AS y FROM ({pairs})")
    series = lambda s: f"SELECT factor, target, date, pairs, round(ic, 8) AS ic FROM ({s})"
    matrix = ", ".join(f"round(avg(ic) FILTER (WHERE target = '{t}'), 8) AS {t}" for t in IC_TARGETS)
    ir = "avg(ic) / nullif(stddev_samp(ic), 0)"

    known = " + ".join(f"CAST({n} IS NOT NULL AS INTEGER)" for n in ZSCORED)
    q = lambda n, p: f"quantile_cont({n}, {p}) OVER (PARTITION BY date)"
    clipped = ", ".join(f"CASE WHEN {n} IS NOT NULL THEN {quantised(f'least(greatest({n}, {q(n, 0.005)}), {q(n, 0.995)})')} END AS {n}" for n in ZSCORED)
    z = ", ".join(f"round(coalesce(({n} - avg({n}) OVER d) / nullif(stddev_samp({n}) OVER d, 0), 0), 8) AS {n}" for n in ZSCORED)

    scored = (
        f"SELECT date, code, s.value AS score, r.value AS ret, liquidity FROM ({of('mom_20')}) s JOIN ({of('label_ret_5d')}) r USING (date, code) "
        f"JOIN (SELECT {key}, code, amount AS liquidity FROM ({bars})) USING (date, code) WHERE s.value IS NOT NULL AND r.value IS NOT NULL"
    )
    w = lambda x: f"sum(({x}) * k) / sum(k)"
    weights = "CASE WHEN count(*) OVER d > 1 THEN pow(0.5, CAST(row_number() OVER (PARTITION BY date ORDER BY score DESC, code) - 1 AS DOUBLE) / (count(*) OVER d - 1)) ELSE 1.0 END"

    folds = " UNION ALL ".join(f"SELECT date, code, value, {i} AS fold FROM ({of(n)}) WHERE value IS NOT NULL" for i, n in enumerate(IC_FACTORS, 1))
    fold_z = f"SELECT date, code, (value - avg(value) OVER w) / nullif(stddev_samp(value) OVER w, 0) AS z FROM ({folds}) WINDOW w AS (PARTITION BY date, fold)"

    # 1999q2, second block: from 1997-04-01 to 1999-04-01 are 730 days, so blocks are of 182
    part = (
        "CASE WHEN date >= DATE '1997-04-01' AND date < DATE '1997-09-30' THEN 'before' WHEN date >= DATE '1997-09-30' AND date < DATE '1998-03-31' THEN 'valid' "
        "WHEN date >= DATE '1998-03-31' AND date < DATE '1999-04-01' THEN 'after' WHEN date >= DATE '1999-04-01' AND date < DATE '1999-07-01' THEN 'test' END"
    )
    placed = (
        "SELECT *, row_number() OVER (PARTITION BY p ORDER BY date) AS up, row_number() OVER (PARTITION BY p ORDER BY date DESC) AS down "
        f"FROM (SELECT date, {part} AS p FROM (SELECT DISTINCT date FROM ({bars})))"
    )
    both = f"SELECT date, code, close, vol, 0 AS src FROM ({bars}) WHERE date < DATE '{CUTOVER}' UNION ALL SELECT date, code, close + 1, vol, 1 FROM ({bars}) WHERE date >= DATE '{OVERLAP}'"
    fresh = " UNION ALL ".join(f"SELECT '{n}' AS name, max(date) AS last_date FROM ({S.panel(n)})" for n in FRESH)
    wide = ", ".join(f"max(value) FILTER (WHERE factor = '{n}') AS {n}" for n in IC_FACTORS)
    cut = f"SELECT * FROM ({_long_sql(IC_FACTORS, 'factor')}) WHERE factor <> 'reversal_5' OR date < '20010101'"
    grid = f"SELECT * FROM (SELECT DISTINCT date FROM ({of('label_ret_5d')})) CROSS JOIN (SELECT DISTINCT code FROM ({of('label_ret_5d')}))"
    fill = ", ".join(n if n != "reversal_5" else f"last_value({n} IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS UNBOUNDED PRECEDING) AS {n}" for n in IC_FACTORS)
    return {
        "asof_quality": f"SELECT {key}, code, roe, q_eps, gross_margin FROM ({S.panel('financial_indicator', ['roe', 'q_eps', 'gross_margin'])})",
        "ic_series_rank": series(spearman),
        "ic_series_pearson": series(ic(pairs)),
        "ic_summary": (
            f"SELECT factor, target, count(*) AS dates, round(avg(ic), 8) AS mean, round(stddev_samp(ic), 8) AS std, round({ir}, 8) AS icir, "
            f"round(avg(CASE WHEN ic > 0 THEN 1.0 ELSE 0.0 END), 8) AS positive_share, round({ir} * sqrt(count(*)), 8) AS t_stat FROM ({spearman}) WHERE ic IS NOT NULL GROUP BY ALL"
        ),
        "ic_matrix": f"SELECT factor, {matrix} FROM ({spearman}) GROUP BY factor",
        "winsor_zscore": f"SELECT {key}, code, {z} FROM (SELECT date, code, {clipped} FROM ({finance}) WHERE {known} >= 1) WINDOW d AS (PARTITION BY date)",
        "wpcc": (
            f"WITH r AS (SELECT date, score AS p, ret AS y, {weights} AS k, avg(score) OVER d AS pm, avg(ret) OVER d AS ym FROM ({scored}) WINDOW d AS (PARTITION BY date)) "
            f"SELECT date, round(({w('p * y')} - {w('p')} * {w('y')}) / (sqrt({w('(p - pm) * (p - pm)')}) * sqrt({w('(y - ym) * (y - ym)')}) + 1e-12), 6) AS wpcc FROM r GROUP BY date"
        ),
        "topk_portfolio": (
            f"WITH b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY score DESC, code) AS n FROM ({scored})) WHERE n <= {TOP}), "
            f"h AS (SELECT *, {MONEY} - coalesce(sum(liquidity) OVER (PARTITION BY date ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM b), "
            "g AS (SELECT *, CASE WHEN l >= 1 THEN greatest(least(l, liquidity), 0) ELSE 0 END AS hold FROM h) "
            f"SELECT date, CAST(count(*) FILTER (WHERE hold > 0) AS BIGINT) AS held, round(sum(hold), 8) AS spent, round(sum(ret * hold) / {MONEY}, 8) AS ret FROM g GROUP BY date"
        ),
        "fold_ensemble": f"SELECT date, code, round(CASE WHEN count(z) = {len(IC_FACTORS)} THEN sum(z) END, 8) AS value FROM ({fold_z}) GROUP BY date, code",
        "season_split": (
            f"SELECT {key}, CASE WHEN p IN ('before', 'after') THEN 'train' ELSE p END AS part FROM ({placed}) "
            "WHERE p = 'test' OR (p IN ('before', 'valid') AND down > 10) OR (p = 'after' AND up > 10 AND down > 10)"
        ),
        "upsert_keep_last": f"SELECT {key}, code, close, vol FROM (SELECT *, row_number() OVER (PARTITION BY date, code ORDER BY src DESC) AS n FROM ({both})) WHERE n = 1",
        "upsert_whole_rows": f"SELECT DISTINCT {key}, code, close, vol FROM ({both})",
        "stream_upsert_keep_last": "SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS day, user_id, count(*) AS n, max(event_id) AS last_event FROM events GROUP BY ALL",
        "backfill_days": (
            "WITH d AS (SELECT CAST(ts AS DATE) AS date, user_id AS code, count(*) AS n FROM events GROUP BY ALL), "
            "late AS (SELECT code, max(date) AS l FROM d GROUP BY code HAVING max(date) < DATE '2024-01-30'), "
            "span AS (SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-30', INTERVAL 1 DAY)) AS DATE) AS o), "
            "days AS (SELECT o FROM span WHERE dayofweek(o) BETWEEN 1 AND 5 AND o > (SELECT max(l) FROM late)) "
            f"SELECT {key}, code, n, false AS is_backfill FROM d UNION ALL SELECT strftime(o, '%Y%m%d'), d.code, n, true FROM d JOIN late ON d.code = late.code AND d.date = late.l CROSS JOIN days"
        ),
        "code_normalize": (
            "WITH r AS (SELECT s_suppkey, CAST(s_suppkey AS VARCHAR) AS k FROM supplier) "
            "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN CASE WHEN len(k) < 6 THEN lpad(k, 6, '0') ELSE k END WHEN 1 THEN lpad(k, 6, '0') WHEN 2 THEN CAST(600000 + s_suppkey AS VARCHAR) "
            "WHEN 3 THEN CAST(920000 + s_suppkey AS VARCHAR) ELSE '1234567' || k END AS code FROM r"
        ),
        "pool_filter": f"SELECT {key}, code, close FROM ({bars}) WHERE code IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000)",
        "date_slice": f"SELECT {key}, code, close FROM ({bars}) WHERE date BETWEEN DATE '1997-12-02' AND DATE '1998-06-30'",
        "freshness_report": (
            "SELECT name, strftime(last_date, '%Y%m%d') AS last_date, CASE WHEN last_date IS NULL THEN 'empty' WHEN last_date > DATE '2001-07-30' THEN 'future' "
            f"WHEN last_date < DATE '2001-07-30' THEN 'stale' ELSE 'ok' END AS status FROM ({fresh})"
        ),
        "manifest": (
            f"WITH v AS ({of('mom_20')}), w AS (SELECT count(DISTINCT date) AS rows, count(DISTINCT code) AS cols, count(value) AS non_null_cells, max(date) AS last_date FROM v) "
            "SELECT w.*, (SELECT count(value) FROM v WHERE v.date = w.last_date) AS last_day_codes, round(non_null_cells / (rows * cols), 8) AS coverage_ratio FROM w"
        ),
        "training_matrix": f"SELECT date, code, {wide} FROM ({_long_sql(IC_FACTORS, 'factor')}) GROUP BY date, code",
        "training_panel": (
            f"SELECT * FROM (SELECT date, code, {fill} FROM ({grid}) LEFT JOIN (SELECT date, code, {wide} FROM ({cut}) GROUP BY date, code) USING (date, code)) "
            f"WHERE coalesce({', '.join(IC_FACTORS)}) IS NOT NULL"
        ),
        "fused_build": _long_sql(FUSED, "factor"),
        "wide_export": f"SELECT date, CAST(code AS VARCHAR) AS code, value FROM ({of('bp')}) WHERE value IS NOT NULL",
        **source_queries.oracles(),
        "unscored_dates": f"SELECT DISTINCT {key} FROM ({bars}) WHERE strftime(date, '%Y%m%d') > (SELECT max(date) FROM ({of('label_ret_20d')}))",
    }
