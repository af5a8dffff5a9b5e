import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from marlstone.operators import evaluate, events, mlp, model, panels, sectors
from marlstone.operators.asof import asof_panel

D = dt.date


def test_asof_edge_cases(spark):
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(8)]
    calendar = spark.createDataFrame([(d,) for d in days], "date date")
    reports = spark.createDataFrame(
        [
            ("a", D(2023, 12, 1), D(2023, 9, 30), 9.0, 9.0),  # before the calendar: lost
            ("a", D(2024, 1, 3), D(2023, 9, 30), 1.0, 5.0),
            ("a", D(2024, 1, 3), D(2023, 12, 31), 2.0, None),  # same day: the later period wins, by column
            ("a", D(2024, 1, 6), D(2024, 3, 31), None, 7.0),  # a weekend; x stays
            ("b", None, D(2024, 3, 31), 3.0, 3.0),  # no date: lost
            ("b", D(2024, 1, 8), D(2023, 12, 31), 4.0, 4.0),
        ],
        "code string, ann_date date, end_date date, x double, y double",
    )
    got = {(r.code, r.date): (r.x, r.y) for r in asof_panel(reports, calendar, ["x", "y"]).collect()}
    assert len(got) == 16
    assert [got["a", d] for d in days] == [(None, None)] * 2 + [(2.0, 5.0)] * 3 + [(2.0, 7.0)] * 3
    assert [got["b", d] for d in days] == [(None, None)] * 7 + [(4.0, 4.0)]


def test_codes_and_dates(spark):
    df = spark.createDataFrame([("1",), ("000001.SZ",), (" 600000.sh ",), ("920000.BJ",), ("12345678",), ("7.BSE",), (None,)], "c string")
    assert [r[0] for r in df.select(panels.normalise_code(F.col("c"))).collect()] == ["000001", "000001", "600000", "920000", "12345678", "000007", None]
    df = spark.createDataFrame([("2024-01-05",), ("20240105",), ("soon",), (None,)], "d string")
    assert [r[0] for r in df.select(panels.parse_date(F.col("d"))).collect()] == [D(2024, 1, 5)] * 2 + [None] * 2


def test_normalise_panel(spark):
    df = spark.createDataFrame([("2024-01-02", "1.SZ", "n", float("nan")), ("2024-01-03", "2.SH", "m", float("inf"))], "trade_date string, stock_code string, stock_name string, x double")
    out = panels.normalise_panel(df)
    assert out.columns == ["date", "code", "x"]
    assert [tuple(r) for r in out.collect()] == [(D(2024, 1, 2), "000001", None), (D(2024, 1, 3), "000002", None)]
    with pytest.raises(ValueError):
        panels.normalise_panel(df.drop("trade_date"))


def test_pool_upsert_and_duplicates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0)], "date int, code string, x double")
    pool = spark.createDataFrame([("a",), ("a",)], "code string")
    assert [r.code for r in panels.in_pool(df, pool).collect()] == ["a"]
    assert panels.in_pool(df, pool.where("false")).count() == 2
    new = spark.createDataFrame([(1, "a", 5.0), (2, "a", 6.0), (1, "b", 2.0)], "date int, code string, x double")
    assert sorted(map(tuple, panels.upsert(df, new, ["date", "code"]).collect())) == [(1, "a", 5.0), (1, "b", 2.0), (2, "a", 6.0)]
    assert panels.upsert(df, new, ["date", "code"], strict=False).count() == 4
    assert panels.duplicate_keys(df.union(df)).count() == 2
    assert [r.x for r in panels.unique_by_key(df.union(new), ["x"]).orderBy("date", "code").collect()] == [5.0, 2.0, 6.0]


def test_backfill_across_a_weekend(spark):
    rows = [(D(2024, 1, 4), "late", 1.0), (D(2024, 1, 5), "later", 2.0), (D(2024, 1, 9), "fresh", 3.0), (D(2024, 1, 3), "late", 0.5)]
    df = spark.createDataFrame(rows, "date date, code string, x double")
    calendar = spark.createDataFrame([(D(2024, 1, 1) + dt.timedelta(days=i), 0 if i in (5, 6) else 1) for i in range(15)], "date date, is_open int")
    out = panels.backfill(df, calendar, F.lit("2024-01-09").cast("date")).where("is_backfill").orderBy("code", "date").collect()
    assert [(r.code, r.date.day, r.x) for r in out] == [("late", 8, 1.0), ("late", 9, 1.0), ("later", 8, 2.0), ("later", 9, 2.0)]


def test_seats(spark):
    rows = [(1, "a", f"{events.INSTITUTION} {i}" if i % 2 else "branch", float(v)) for i, v in enumerate([5, 4, 3, 2, 1, -9, 1])]
    rows += [(1, "b", None, 0.0), (2, "a", "branch", 2.0), (2, "a", "branch", -2.0)]
    got = {(r.date, r.code): r for r in events.seat_features(spark.createDataFrame(rows, "date int, code string, org_name string, net_buy_amount double")).collect()}
    assert got[1, "a"].org_count == 3 and got[1, "a"].top_net_share == pytest.approx(15 / 25)
    assert got[1, "b"].org_count == 0 and got[1, "b"].top_net_share is None
    assert got[2, "a"].top_net_share == 0


def test_sectors(spark):
    series = spark.createDataFrame([(d, s, float(10 * d + i)) for d in (1, 2, 3) for i, s in enumerate(("p", "q")) if (d, s) != (2, "q")], "date int, sector string, close double")
    bridge = spark.createDataFrame([("a", "p"), ("a", "q"), ("a", "p"), ("b", "q"), ("c", "r")], "code string, sector string")
    from marlstone.functions.signal import change_unpadded, col

    change = sectors.sector_signals(series, {"r": change_unpadded(col("close"), 1)})
    got = {(r.date, r.code): r.r for r in sectors.sector_average(change, bridge, "r").collect()}
    assert got == {(2, "a"): pytest.approx(1.0), (3, "a"): pytest.approx(0.5)}  # q has no date 2, so no change over it
    values = spark.createDataFrame([(1, c, v) for c, v in zip("abcd", (1.0, 2.0, 2.0, None), strict=True)], "date int, code string, v double")
    members = spark.createDataFrame([(c, "p") for c in "abc"] + [("a", "q"), ("b", "q"), ("d", "p")], "code string, sector string")
    ranks = {r.code: r.mean_rank for r in sectors.member_ranks(values, members, series, "v").collect()}
    assert ranks == {"a": pytest.approx(1 / 3), "b": pytest.approx(2.5 / 3), "c": pytest.approx(2.5 / 3)}
    plain = {r.code: r.mean_rank for r in sectors.member_ranks(values, members, series, "v", least=9).collect()}
    assert plain == {"a": 1.0, "b": 2.0, "c": 2.0, "d": None}
    counts = {(r.date, r.code): r.sectors for r in sectors.sector_counts(values.select("date", "code"), bridge).collect()}
    assert counts == {(1, "a"): 2.0, (1, "b"): 1.0, (1, "c"): 1.0, (1, "d"): 0.0}


def test_ic_needs_ten_pairs_and_matches_pandas(spark):
    rng = np.random.default_rng(0)
    x = pd.DataFrame([(d, c, np.round(rng.normal(), 1), rng.normal()) for d, n in ((1, 9), (2, 10), (3, 40)) for c in range(n)], columns=["date", "code", "x", "y"])
    f = spark.createDataFrame(x[["date", "code", "x"]].rename(columns={"x": "value"})).withColumn("factor", F.lit("f"))
    t = spark.createDataFrame(x[["date", "code", "y"]].rename(columns={"y": "value"})).withColumn("target", F.lit("t"))
    for method in ("spearman", "pearson"):
        got = {r.date: r.ic for r in evaluate.ic_series(f, t, method).collect()}
        want = {d: g.x.rank().corr(g.y.rank()) if method == "spearman" else g.x.corr(g.y) for d, g in x.groupby("date") if len(g) >= 10}
        assert got.keys() == want.keys()
        assert all(got[d] == pytest.approx(want[d]) for d in want)
    summary = evaluate.ic_summary(evaluate.ic_series(f, t)).first()
    s = pd.Series([v for v in evaluate.ic_series(f, t).toPandas().ic])
    assert summary.dates == 2 and summary.mean == pytest.approx(s.mean()) and summary.t_stat == pytest.approx(s.mean() / (s.std() / np.sqrt(2)))
    with pytest.raises(ValueError):
        evaluate.ic_series(f, t, "kendall")


def test_portfolio_capacity(spark):
    rows = [(1, c, float(10 - i), liq, r) for i, (c, liq, r) in enumerate([("a", 60.0, 0.1), ("b", 40.0, 0.2), ("c", 50.0, 0.3)])]
    rows += [(2, "a", 1.0, 99.5, 0.1), (2, "b", 0.5, 50.0, 0.2), (3, "a", 1.0, 10.0, 0.5)]
    got = {r.date: r for r in model.top_portfolio(spark.createDataFrame(rows, "date int, code string, score double, liquidity double, ret double"), top=3, money=100.0).collect()}
    assert (got[1].held, got[1].spent) == (2, 100.0) and got[1].ret == pytest.approx((6 + 8) / 100)
    assert (got[2].held, got[2].spent) == (1, 99.5)  # less than one is left: not spent
    assert got[3].spent == 10.0


def test_wpcc_zscore_and_ensemble(spark):
    rng = np.random.default_rng(1)
    pred, y = rng.normal(size=30), rng.normal(size=30)
    df = spark.createDataFrame([(1, i, float(a), float(b)) for i, (a, b) in enumerate(zip(pred, y, strict=True))], "date int, code int, pred double, y double")
    assert model.rank_weighted_corr(df).first().wpcc == pytest.approx(-mlp.wpcc_gradient(pred, y)[0])
    z = model.winsor_zscore(df.withColumn("pred", F.when(F.col("code") != 3, F.col("pred"))), ["pred", "y"]).toPandas()
    assert z.pred.mean() == pytest.approx(0, abs=1e-9) and z[z.code == 3].pred.iloc[0] == 0
    folds = spark.createDataFrame([(1, c, f, float(c * f)) for c in (1, 2, 3) for f in (1, 2) if (c, f) != (3, 2)], "date int, code int, fold int, value double")
    got = {r.code: r.value for r in model.fold_ensemble(folds, 2).collect()}
    assert got[3] is None and got[1] < got[2]


def test_season_split_purges_and_shifts(spark):
    days = pd.bdate_range("2022-01-01", "2024-12-31")
    dates = spark.createDataFrame([(d.date(),) for d in days], "date date")
    parts = lambda season, period: model.season_split(dates, season, period).toPandas().groupby("part").date.apply(lambda s: sorted(s)).to_dict()
    p = parts("2024q3", 2)
    start, gap = D(2022, 7, 1), dt.timedelta(days=731 // 4)
    inside = lambda a, b: [d.date() for d in days if a <= d.date() < b]
    assert p["valid"] == inside(start + gap, start + 2 * gap)[:-10]
    train = inside(start, start + gap)[:-10] + inside(start + 2 * gap, D(2024, 7, 1))[10:-10]
    assert p["train"] == [d for d in train if not D(2024, 2, 1) <= d <= D(2024, 2, 23)]
    assert p["test"] == inside(D(2024, 7, 1), D(2024, 10, 1)) + inside(D(2024, 10, 1), D(2024, 10, 17))
    q = parts("2024q4", 1)
    assert q["test"] == inside(D(2024, 10, 17), D(2025, 1, 1)) and D(2024, 10, 8) in q["train"]
    folds = [set(r.date for r in model.shuffled_split(dates, k).where("part = 'valid'").collect()) for k in range(1, 5)]
    assert set.union(*folds) == {d.date() for d in days} and sum(map(len, folds)) == len(days)


def test_training_panel_carries_late_factors(spark):
    f = spark.createDataFrame([("a", 1, "x", 1.0), ("a", 3, "x", 3.0), ("b", 1, "x", 5.0), ("b", 1, "y", 6.0)], "factor string, date int, code string, value double")
    labels = spark.createDataFrame([(d, c) for d in (1, 2, 3) for c in "xy"], "date int, code string")
    got = {(r.date, r.code): (r.a, r.b) for r in model.training_panel(f, labels, ["a", "b"]).collect()}
    assert got == {(1, "x"): (1.0, 5.0), (2, "x"): (None, 5.0), (3, "x"): (3.0, 5.0), (1, "y"): (None, 6.0), (2, "y"): (None, 6.0), (3, "y"): (None, 6.0)}
    wide = model.training_matrix(f, ["a", "b"])
    assert model.used_columns(wide.withColumn("z", F.lit(0.0)), ["a", "b", "z"]) == ["a", "b"]


def test_perceptron_learns_and_predicts(spark):
    rng = np.random.default_rng(2)
    dates = []
    for _ in range(20):
        x = rng.normal(size=(60, 5))
        dates.append((x, x[:, 0] - x[:, 1] + 0.1 * rng.normal(size=60)))
    net = mlp.Perceptron(5, (16, 8))
    p, y = rng.normal(size=12), rng.normal(size=12)
    loss, g = mlp.wpcc_gradient(p, y)
    for i in range(12):
        e = np.zeros(12)
        e[i] = 1e-6
        assert (mlp.wpcc_gradient(p + e, y)[0] - loss) / 1e-6 == pytest.approx(g[i], abs=1e-4)
    losses = net.fit(dates, epochs=15, rate=5e-3)
    assert losses[-1] < losses[0] and losses[-1] < -0.8
    names = [f"f{i}" for i in range(5)]
    df = spark.createDataFrame([(1, i, *map(float, r)) for i, r in enumerate(dates[0][0])], "date int, code int, " + ", ".join(f"{n} double" for n in names))
    out = mlp.predict(df, net, names).orderBy("code").toPandas()
    np.testing.assert_allclose(out.value, net.predict(dates[0][0]))


def test_best_checkpoint():
    assert mlp.best_checkpoint(["a-val_wei=0.2.ckpt", "b-val_wei=0.31.ckpt", "last.ckpt"]) == "b-val_wei=0.31.ckpt"
    assert mlp.best_checkpoint(["last.ckpt"]) is None
