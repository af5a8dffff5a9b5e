"""Primitives against pandas on random panels with NULLs, ties, zeros and gaps."""

import numpy as np
import pandas as pd
import pytest

from marlstone.functions import signal as S
from marlstone.functions.sqltext import SqlText

X, Y = S.col("x"), S.col("y")


@pytest.fixture(scope="module")
def panel():
    rng = np.random.default_rng(0)
    rows = []
    for code in range(8):
        for date in range(45):
            if rng.random() < 0.1:
                continue
            x = np.round(rng.normal(2, 3), 1) if rng.random() > 0.15 else np.nan
            y = float(rng.integers(0, 4)) if rng.random() > 0.1 else np.nan
            rows.append((date, code, x, y, code % 3))
    rows += [(d, 50, 2.5, 1.0, 0) for d in range(45)]  # constant
    rows += [(0, 60, 1.0, 1.0, 1), (1, 60, np.nan, 0.0, 1)]  # short
    rows += [(99, c, np.nan, np.nan, 0) for c in range(5)]  # a date without values
    rows += [(100, 7, 3.0, 1.0, 0)]  # a date of one
    return pd.DataFrame(rows, columns=["date", "code", "x", "y", "g"]).sort_values(["code", "date"]).reset_index(drop=True)


@pytest.fixture(scope="module")
def frame(spark, panel):
    rows = [tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in panel.itertuples(index=False)]
    return spark.createDataFrame([(int(a), int(b), c, d, int(e)) for a, b, c, d, e in rows], "date int, code int, x double, y double, g int")


def values(frame, panel, sig):
    got = S.with_signals(frame, {"v": sig}).select("date", "code", "v").toPandas()
    return panel[["date", "code"]].merge(got, on=["date", "code"], how="left").v.astype(float).to_numpy()


def by_code(panel, f, column="x"):
    return panel.groupby("code")[column].transform(f).to_numpy()


ROLLING = {
    "mean": lambda s: s.rolling(5, min_periods=3).mean(), "std": lambda s: s.rolling(5, min_periods=3).std(), "sum": lambda s: s.rolling(5, min_periods=3).sum(),
    "max": lambda s: s.rolling(5, min_periods=3).max(), "min": lambda s: s.rolling(5, min_periods=3).min(),
}


@pytest.mark.parametrize("kind", ROLLING)
def test_rolling(frame, panel, kind):
    np.testing.assert_allclose(values(frame, panel, S.rolling(kind, X, 5, 3)), by_code(panel, ROLLING[kind]), atol=1e-9)


def test_rolling_defaults():
    assert S.mean(X, 20).args[2] == 10 and S.high(X, 20).args[2] == 1


def test_skew_and_kurt(frame, panel):
    np.testing.assert_allclose(values(frame, panel, S.skew(X, 8, 4)), by_code(panel, lambda s: s.rolling(8, min_periods=4).skew()), atol=1e-8)
    np.testing.assert_allclose(values(frame, panel, S.kurt(X, 8, 5)), by_code(panel, lambda s: s.rolling(8, min_periods=5).kurt()), atol=1e-7)


def test_change_pads_forward(frame, panel):
    def pad(s):
        f = s.ffill()
        return f / f.shift(3).replace(0, np.nan) - 1

    np.testing.assert_allclose(values(frame, panel, S.change(X, 3)), by_code(panel, pad), atol=1e-12)
    plain = by_code(panel, lambda s: s / s.shift(2).replace(0, np.nan) - 1)
    np.testing.assert_allclose(values(frame, panel, S.change_unpadded(X, 2)), plain, atol=1e-12)


def test_lag_and_lead(frame, panel):
    np.testing.assert_allclose(values(frame, panel, S.lag(X, 2)), by_code(panel, lambda s: s.shift(2)))
    np.testing.assert_allclose(values(frame, panel, S.lag(X, -2)), by_code(panel, lambda s: s.shift(-2)))


def test_history_rank(frame, panel):
    want = by_code(panel, lambda s: s.expanding(10).rank(pct=True))
    want = np.where(panel.x.isna(), np.nan, want)
    np.testing.assert_allclose(values(frame, panel, S.history_rank(X, 10)), want)


def test_history_rank_of_equal_windows_is_a_tie(spark):
    """A value that enters as its equal leaves changes a window's order only, and so the last bits of its deviation."""
    rng = np.random.default_rng(3)
    rows, want = [], []
    for code in range(12):
        x = rng.normal(0, 3, 100)
        for i in range(20, 100, 7):
            x[i] = x[i - 20]
        rows += [(d, code, float(v)) for d, v in enumerate(x)]
        windows = [tuple(sorted(x[max(0, d - 19) : d + 1])) for d in range(100)]
        deviations = {w: np.std(w, ddof=1) for w in windows if len(w) > 9}
        for d in range(100):
            seen = [w for w in windows[9 : d + 1]]
            ties = sum(w == windows[d] for w in seen)
            below = sum(deviations[w] < deviations[windows[d]] for w in seen if w != windows[d])
            want.append((below + (ties + 1) / 2) / len(seen) if len(seen) >= 60 else np.nan)
    panel = pd.DataFrame(rows, columns=["date", "code", "x"])
    got = values(spark.createDataFrame(panel), panel, S.history_rank(S.std(X, 20, 10), 60))
    np.testing.assert_allclose(got, want, atol=1e-12)


def test_slope_leaves_nulls_out(frame, panel):
    def slope(w):
        v = w[~np.isnan(w)]
        return np.polyfit(np.arange(len(v)), v, 1)[0] if len(v) >= 3 else np.nan

    want = by_code(panel, lambda s: pd.Series([slope(s.to_numpy()[max(0, i - 4) : i + 1]) for i in range(len(s))], index=s.index))
    np.testing.assert_allclose(values(frame, panel, S.slope(X, 5, 3)), want, atol=1e-9)


def test_beta(spark, frame, panel):
    both = panel.dropna(subset=["x", "y"]).reset_index(drop=True)
    want = np.full(len(both), np.nan)
    for _, g in both.groupby("code"):
        cov, var = g.x.rolling(10, min_periods=5).cov(g.y), g.y.rolling(10, min_periods=5).var()
        want[g.index] = (cov / var.replace(0, np.nan)).to_numpy()
    got = values(frame.where("x is not null and y is not null"), both, S.beta(X, Y, 10, 5))
    np.testing.assert_allclose(got, want, atol=1e-8)


def test_cross_rank_winsorises_first(frame, panel):
    def rank(s):
        lo, hi = s.quantile(0.01), s.quantile(0.99)
        return (s if np.isnan(lo) else s.clip(lo, hi)).rank(pct=True)

    np.testing.assert_allclose(values(frame, panel, S.cross_rank(X)), panel.groupby("date").x.transform(rank).to_numpy(), atol=1e-12)
    np.testing.assert_allclose(values(frame, panel, S.pct_rank(Y)), panel.groupby("date").y.rank(pct=True).to_numpy(), atol=1e-12)
    np.testing.assert_allclose(values(frame, panel, S.pct_rank(Y, "g")), panel.groupby(["date", "g"]).y.rank(pct=True).to_numpy(), atol=1e-12)


def test_ranks_are_in_range_and_invariant(frame, panel):
    r = values(frame, panel, S.pct_rank(X))
    assert np.nanmin(r) > 0 and np.nanmax(r) <= 1
    np.testing.assert_allclose(values(frame, panel, S.pct_rank(X * 2 + 7)), r)


def test_nulls_in_row_wise_functions(spark):
    df = spark.createDataFrame([(1, 1, None, 1.0), (1, 2, -2.0, 0.0), (1, 3, 4.0, 2.0)], "date int, code int, x double, y double")
    sigs = {"div": X / Y, "ln": S.log(X), "clip": S.clip(X, -1, 1), "pos": S.positive(X), "zero": S.zero_if_null(X), "most": S.largest(X, Y), "strict": S.largest_strict(X, Y), "low": S.smallest(X, Y), "abs": S.absolute(X), "neg": 1 - X}
    rows = {r.code: r.asDict() for r in S.with_signals(df, sigs).collect()}
    assert [rows[1][k] for k in sigs] == [None, None, None, None, 0.0, 1.0, None, 1.0, None, None]
    assert [rows[2][k] for k in sigs] == [None, None, -1.0, None, -2.0, 0.0, 0.0, -2.0, 2.0, 3.0]
    assert rows[3]["div"] == 2.0 and rows[3]["ln"] == pytest.approx(np.log(4)) and rows[3]["clip"] == 1.0


def test_equal_parts_are_computed_once_and_exchanges_shared(frame):
    low = S.Lowering(frame)
    out = low.add({"a": S.mean(S.change(X, 1), 5, 3), "b": S.std(S.change(X, 1), 5, 3), "c": S.change(X, 1) / S.mean(S.change(X, 1), 5, 3)})
    assert len(low.names) == 4  # pad, lag, mean, std
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_sql_text_agrees(frame, panel):
    import duckdb

    sigs = {"a": S.cross_rank(S.change(X, 3)), "b": S.skew(X, 8, 4), "c": S.slope(X, 5, 3), "d": S.history_rank(X, 10), "e": S.clip(S.std(X, 5, 3), 0.5, 2)}
    ctes, final = SqlText("p").select(sigs)
    con = duckdb.connect()
    con.register("p", panel)
    con.execute("CREATE VIEW q AS SELECT date, code, CASE WHEN isnan(x) THEN NULL ELSE x END AS x FROM p")
    want = con.execute(f"WITH {', '.join(ctes)} {final}".replace("FROM p", "FROM q")).fetchdf().sort_values(["code", "date"])
    got = S.with_signals(frame, sigs).toPandas().sort_values(["code", "date"])
    for k in sigs:
        np.testing.assert_allclose(got[k].astype(float).to_numpy(), want[k].astype(float).to_numpy(), atol=1e-8)


def test_values_do_not_look_ahead(frame, panel):
    sig = S.mean(S.change(X, 2), 5, 2) / S.high(X, 10, 2)
    whole = values(frame, panel, sig)
    cut = values(frame.where("date < 30"), panel, sig)
    early = (panel.date < 30).to_numpy()
    np.testing.assert_allclose(cut[early], whole[early])
