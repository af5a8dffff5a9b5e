import datetime as dt

import pytest
from pyspark.sql import functions as F

from marlstone.factors import FactorSpec, all_factors, get_factor, ordered_names
from marlstone.factors.registry import register
from marlstone.functions import signal as S
from marlstone.plans import cli, ingest, planner
from marlstone.plans.build import build, compute
from marlstone.plans.run import plan, run
from marlstone.plans.run import slowest
from marlstone.plans.store import FactorStore, check_contract, from_wide, to_wide
from marlstone.sources.catalog import ParquetCatalog
from marlstone.sources.sample import SampleCatalog

D = dt.date
SF = "/root/testdata/sf0.001"


def test_registry():
    specs = all_factors()
    assert len(specs) == 154
    counts = {c: sum(s.category == c for s in specs.values()) for c in {s.category for s in specs.values()}}
    assert counts == {"price": 31, "timeseries": 4, "valuation": 13, "quality": 30, "event": 12, "fund_flow": 10, "margin": 3, "financial": 24, "enhanced": 5, "sector": 7, "neutral": 11, "target": 4}
    with pytest.raises(ValueError):
        register(get_factor("mom_20"))
    with pytest.raises(KeyError):
        get_factor("nothing")
    names = ordered_names(["margin_leverage_ratio", "label_ret_1d", "mom_20", "bp"])
    assert names == ["mom_20", "bp", "label_ret_1d", "margin_leverage_ratio"]


def test_lookback_follows_windows():
    x = S.col("x")
    of = lambda sig: FactorSpec("t", "c", "p", ("p",), sig).lookback
    assert of(x) == 0 and of(S.lag(x, 5)) == 5 and of(S.lag(x, -5)) == 0
    assert of(S.mean(S.lag(x, 5), 20)) == 24
    assert of(S.history_rank(x, 60)) is None
    assert get_factor("gross_margin_stability_8q").lookback == 503
    assert planner.scan_start(get_factor("ts_vol_regime_60"), D(2024, 1, 1)) is None


def test_decisions():
    end = D(2024, 5, 10)
    decide = planner.decide
    assert decide(None, {"a": end}, end).action == "rebuild"
    assert decide(D(2024, 5, 10), {"a": end}, end).action == "skip"
    assert decide(D(2024, 5, 12), {"a": end}, end).action == "rebuild"  # from the future
    assert decide(D(2024, 5, 8), {"a": end, "b": D(2024, 5, 8)}, end).action == "skip"
    d = decide(D(2024, 5, 8), {"a": D(2024, 5, 20), "b": D(2024, 5, 9)}, end)
    assert d.action == "incremental" and d.start == D(2024, 5, 9)
    assert decide(D(2024, 5, 8), {"a": None}, end).action == "skip"
    assert decide(D(2024, 5, 10), {"a": end}, end, force=True).action == "rebuild"
    assert planner.effective_end(D(2024, 5, 10), dt.datetime(2024, 5, 10, 12)) == D(2024, 5, 9)
    assert planner.effective_end(D(2024, 5, 10), dt.datetime(2024, 5, 10, 18)) == D(2024, 5, 10)
    assert planner.dated_inputs(get_factor("bp_neutral")) == ["finance"]  # dimensions say nothing of freshness


def test_fused_build_equals_one_by_one(spark):
    catalog = SampleCatalog(spark, SF)
    names = ["mom_5", "bias_20", "bp", "pe_ttm", "dv_composite", "label_ret_1d", "dt_org_count"]
    fused = {(r.factor, r.date, r.code): r.value for r in build(catalog, names).collect()}
    single = {(n, r.date, r.code): r.value for n in names for r in compute(catalog, n).collect()}
    assert fused == single


def test_fused_build_shares_exchanges(spark):
    names = [n for n in all_factors() if all_factors()[n].panel == "daily_adj" and all_factors()[n].category in ("price", "timeseries", "enhanced")]
    text = build(SampleCatalog(spark, SF), names)._jdf.queryExecution().executedPlan().toString()
    # one for the bars, one by code (bars are keyed by date and code), one by factor and date
    assert len(names) > 25 and text.count("Exchange hashpartitioning") <= 3


@pytest.fixture
def source(spark, tmp_path):
    rows = [(f"2024-01-{d:02d}", f"{c:06d}.SZ", 10.0 + d * c % 7, 1.0 * c) for d in range(1, 29) for c in range(1, 13)]
    bars = spark.createDataFrame(rows, "trade_date string, stock_code string, close double, vol double").withColumns({"open": F.col("close"), "high": F.col("close") + 1, "low": F.col("close") - 1, "amount": F.col("vol") * 5, "pct_chg": F.lit(0.1)})
    bars.write.parquet(str(tmp_path / "src" / "daily_adj.parquet"))
    reports = spark.createDataFrame([(f"{c:06d}.SZ", "2023-12-31", f"2024-01-{c + 2:02d}", 0.1 * c) for c in range(1, 13)], "stock_code string, end_date string, ann_date string, roe double")
    from marlstone.sources.catalog import REPORT_COLUMNS

    reports.withColumns({c: F.lit(1.0) for c in REPORT_COLUMNS["financial_indicator"] if c != "roe"}).write.parquet(str(tmp_path / "src" / "financial_indicator.parquet"))
    spark.createDataFrame([(f"2024-01-{d:02d}", 1) for d in range(1, 29)], "date string, is_open int").write.parquet(str(tmp_path / "src" / "calendar.parquet"))
    return str(tmp_path / "src"), bars, str(tmp_path)


def test_store_plan_and_incremental_run(spark, source):
    src, bars, tmp = source
    store = FactorStore(spark, tmp + "/store")
    names = ["mom_5", "label_ret_1d", "roe"]
    now = dt.datetime(2024, 1, 20, 19)
    early = tmp + "/early"
    bars.where("trade_date <= '2024-01-20'").write.parquet(early + "/daily_adj.parquet")
    for t in ("financial_indicator", "calendar"):
        spark.read.parquet(f"{src}/{t}.parquet").write.parquet(f"{early}/{t}.parquet")
    assert run(ParquetCatalog(spark, early), store, names, now) == {"mom_5": "rebuild", "roe": "rebuild", "label_ret_1d": "rebuild"}
    assert plan(ParquetCatalog(spark, early), store, ["mom_5"], now)["mom_5"].action == "skip"
    assert store.info("mom_5")["last_date"] == "2024-01-20" and store.info("mom_5")["version"] == 1
    later = ParquetCatalog(spark, src)
    now = dt.datetime(2024, 1, 28, 19)
    assert run(later, store, ["mom_5"], now) == {"mom_5": "incremental"}
    got = sorted(map(tuple, store.load("mom_5").collect()))
    assert got == sorted(map(tuple, compute(later, "mom_5").collect()))  # as a full build
    assert store.info("mom_5")["version"] == 2
    with pytest.raises(FileNotFoundError):
        store.load("bp")


def test_incremental_run_reads_from_where_windows_reach(spark, source):
    src, bars, tmp = source
    plan_of = lambda df: df._jdf.queryExecution().executedPlan().toString()
    catalog = ParquetCatalog(spark, src).since(dt.date(2024, 1, 15))
    assert "GreaterThanOrEqual(trade_date,2024-01-15)" in plan_of(build(catalog, ["amplitude_20"]))
    assert catalog.panel("daily_adj").count() == 14 * 12


def test_many_factors_are_stored_in_one_write(spark, source):
    src, _, tmp = source
    catalog, store = ParquetCatalog(spark, src), FactorStore(spark, tmp + "/many")
    names = ["mom_5", "bias_20", "label_ret_1d"]
    store.write_all(build(catalog, names), names)
    for n in names:
        assert sorted(map(tuple, store.load(n).collect()), key=str) == sorted(map(tuple, compute(catalog, n).collect()), key=str)
        assert store.info(n)["version"] == 1 and store.info(n)["cols"] == 12
    again = store.write("mom_5", store.load("mom_5"))
    assert {k: again[k] for k in ("rows", "cols", "non_null_cells", "last_date")} == {k: store.info("mom_5")[k] for k in ("rows", "cols", "non_null_cells", "last_date")}
    assert again["version"] == 2
    assert slowest({"a": 1.0, "b": 3.0, "c": 2.0}, 2) == [("b", 3.0), ("c", 2.0)]


def test_one_pass_for_evaluation(spark):
    from marlstone import queries

    text = queries.ic_matrix(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet") == 1


def test_command_line_writes_files(spark, source, capsys):
    import json

    src, _, tmp = source
    assert cli.main(["--factor", "mom_5", "--source", src, "--store", tmp + "/s", "--wide", tmp + "/wide", "--manifest", tmp + "/out/manifest.json", "--timing"]) == 0
    assert "mom_5" in capsys.readouterr().out
    from marlstone.sources.feather import read_factors

    assert read_factors(spark, tmp + "/wide/*.feather").count() == FactorStore(spark, tmp + "/s").load("mom_5").where("value IS NOT NULL").count()
    assert json.loads(open(tmp + "/out/manifest.json").read())["name"] == "mom_5"


def test_contract_and_wide_forms(spark):
    values = spark.createDataFrame([(1, "a", 1.0), (1, "b", None), (2, "a", 3.0)], "date int, code string, value double")
    check_contract(values)
    with pytest.raises(ValueError):
        check_contract(values.union(values))
    with pytest.raises(ValueError):
        check_contract(values.drop("value"))
    wide = to_wide(values, ["a", "b"])
    assert sorted(map(tuple, from_wide(wide).collect())) == [(1, "a", 1.0), (2, "a", 3.0)]


def test_cli(capsys):
    assert cli.main(["--list"]) == 0
    assert "mom_20" in capsys.readouterr().out
    assert cli.main([]) == 2
    args = cli.parser().parse_args(["--all", "--skip-targets"])
    assert len(cli.chosen(args)) == 150
    assert cli.chosen(cli.parser().parse_args(["--targets-only"])) == ["label_ret_10d", "label_ret_1d", "label_ret_20d", "label_ret_5d"]


def test_ingest_merges_by_full_key(spark):
    schema = "trade_date date, stock_code string, org_name string, reason string, buy_amount double"
    stored = spark.createDataFrame([(D(2024, 1, 2), "1", "s1", "r", 1.0), (D(2024, 1, 2), "1", "s2", "r", 2.0)], schema)
    asked = []

    def fetch(a, b):
        asked.append((a, b))
        return spark.createDataFrame([(D(2024, 1, 2), "1", "s2", "r", 5.0), (D(2024, 1, 3), "1", "s1", "r", 3.0)], schema)

    out = ingest.update("dragon_tiger", stored, fetch, D(2020, 1, 1), D(2024, 1, 3))
    assert asked == [(D(2023, 12, 30), D(2024, 1, 3))]
    assert sorted((r.trade_date.day, r.org_name, r.buy_amount) for r in out.collect()) == [(2, "s1", 1.0), (2, "s2", 5.0), (3, "s1", 3.0)]
    assert ingest.update("dragon_tiger", None, fetch, D(2020, 1, 1), D(2024, 1, 3)).count() == 2
    assert asked[-1][0] == D(2020, 1, 1)


def test_ingest_fills_lagging_codes(spark):
    schema = "trade_date date, stock_code string, close double"
    stored = spark.createDataFrame([(D(2024, 1, 2), "1", 1.0), (D(2024, 1, 2), "2", 2.0)], schema)
    calendar = spark.createDataFrame([(D(2024, 1, d), 1) for d in range(1, 8)], "date date, is_open int")
    out = ingest.update("daily", stored, lambda a, b: spark.createDataFrame([(D(2024, 1, 4), "1", 3.0)], schema), D(2020, 1, 1), D(2024, 1, 4), calendar)
    filled = out.where("is_backfill").orderBy("trade_date").collect()
    assert [(r.trade_date.day, r.stock_code, r.close) for r in filled] == [(3, "2", 2.0), (4, "2", 2.0)]
    assert ingest.stale_days(stored.union(spark.createDataFrame([(D(2024, 1, 9), "1", 1.0)], schema)), "trade_date", "stock_code", 0.9) == 7
