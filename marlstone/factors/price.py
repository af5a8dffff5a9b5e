"""Price, volume and own-history factors over bars."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import (
    absolute, change, clip, col, high, history_rank, kurt, lag, largest, largest_strict, low, mean, skew, smallest, std,
)

open_, high_, low_, close, vol, amount = (col(c) for c in ("open", "high", "low", "close", "vol", "amount"))
pre_close = col("pre_close")
ret1 = change(close, 1)


def _bars(name, raw, category="price", panel="daily_adj", description=""):
    return factor(name, category, panel, raw, description=description)


for n in (5, 10, 20, 60):
    _bars(f"mom_{n}", change(close, n), description=f"change of the close over {n} rows")
_bars("mom_120_skip5", lag(close, 5) / lag(close, 120) - 1, description="change from 120 to 5 rows ago, unpadded")
for n in (1, 5, 10):
    _bars(f"reversal_{n}", -change(close, n), description=f"negative change over {n} rows")
_bars("volatility_20", -std(ret1, 20, 10))
_bars("volatility_60", -std(ret1, 60, 30))
_bars("downside_vol_20", -std(clip(ret1, high=0), 20, 10), description="rises count as zero")
_bars("amplitude_20", -mean((high_ - low_) / close, 20, 10))
_bars("bias_20", close / mean(close, 20, 10) - 1)

_step = close - lag(close, 1)
_gain, _loss = mean(clip(_step, low=0), 14, 7), mean(-clip(_step, high=0), 14, 7)
_bars("rsi_14", -(100 - 100 / (1 + _gain / _loss)), description="simple means; NULL without a fall in the window")

_bars("max_drawdown_60", low(close / high(close, 60, 30) - 1, 60, 30), description="deep falls rank low")
_bars("ret_skew_20", skew(ret1, 20, 10))
_bars("ret_kurt_20", -kurt(ret1, 20, 10))
_bars("volume_ratio_20", -(vol / mean(vol, 20, 10) - 1))
_bars("amount_ratio_20", -(amount / mean(amount, 20, 10) - 1))
_bars("shadow_upper_20", -mean((high_ - largest(open_, close)) / (high_ - low_), 20, 10), panel="daily")
_bars("shadow_lower_20", mean((smallest(open_, close) - low_) / (high_ - low_), 20, 10), panel="daily")
_bars("gap_ratio_20", -mean(open_ / pre_close - 1, 20, 10), panel="daily")
_bars("price_position_60", (close - low(close, 60, 30)) / (high(close, 60, 30) - low(close, 60, 30)))
_bars("ma_convergence_20_60", mean(close, 20, 10) / mean(close, 60, 30) - 1)
_bars("mom_4w", change(close, 4), panel="kline_adj_weekly")
_bars("mom_12w", change(close, 12), panel="kline_adj_weekly")
_bars("mom_3m", change(close, 3), panel="kline_adj_monthly")
_bars("mom_6m", change(close, 6), panel="kline_adj_monthly")
_bars("breakout_60", close / high(high_, 60, 30) - 1)
_range = largest_strict(high_ - low_, absolute(high_ - pre_close), absolute(low_ - pre_close))
_bars("atr_20", -mean(_range, 20, 10), panel="daily", description="mean true range; NULL if any part is")
_bars("pct_chg_vol_20", -std(col("pct_chg"), 20, 10))

_bars("ts_mom_accel_20", change(close, 20) - lag(change(close, 20), 20), "timeseries")
_bars("ts_vol_regime_60", history_rank(std(ret1, 20, 10), 60), "timeseries", description="rank in all of the code's history, of 60 values at least")
_bars("ts_price_self_rank_60", (close - low(close, 60)) / (high(close, 60) - low(close, 60)), "timeseries")
_bars("ts_volume_zscore_20", -(vol - mean(vol, 20, 10)) / std(vol, 20, 10), "timeseries")
