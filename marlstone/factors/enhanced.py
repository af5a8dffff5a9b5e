"""Price factors scaled by volatility, and the correlation of price and volume."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import Sig, change, clip, col, mean, std

close = col("close")
ret1, vol1 = change(close, 1), change(col("vol"), 1)


def mixed_corr(a: Sig, b: Sig, rows: int, least: int) -> Sig:
    """Population covariance over sample deviations, each over its own values: a correlation shrunk by (n-1)/n."""
    joint = mean(a * b, rows, least) - mean(a, rows, least) * mean(b, rows, least)
    return clip(joint / (std(a, rows, least) * std(b, rows, least)), -1, 1)


price_volume_corr = mixed_corr(ret1, vol1, 20, 10)

factor("mom_20_vol_adj", "enhanced", "daily_adj", change(close, 20) / std(ret1, 60, 30))
factor("mom_60_vol_adj", "enhanced", "daily_adj", change(close, 60) / std(ret1, 60, 30))
factor("reversal_5_vol_adj", "enhanced", "daily_adj", -change(close, 5) / std(ret1, 20, 10))
factor("return_stability_60", "enhanced", "daily_adj", change(close, 60) / std(ret1, 60, 30), description="the same as mom_60_vol_adj, kept under its own name")
factor("price_volume_corr_20", "enhanced", "daily_adj", price_volume_corr)
