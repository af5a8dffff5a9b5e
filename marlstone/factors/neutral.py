"""Factors ranked within their industry first. Codes without an industry are left out."""

from marlstone.factors.enhanced import price_volume_corr
from marlstone.factors.registry import factor
from marlstone.functions.signal import Sig, change, col, mean, pct_rank, positive, std


def neutral(raw: Sig) -> Sig:
    return pct_rank(raw, "industry")


def _add(name, panel, signal, *inputs):
    factor(name, "neutral", f"{panel}_by_industry", signal, (*(inputs or (panel,)), "stock_list"))


close = col("close")
_add("bp_neutral", "finance", neutral(1 / col("pb")))
_add("sp_ttm_neutral", "finance", neutral(1 / col("ps_ttm")))
_add("turnover_20_neutral", "finance", neutral(mean(col("turnover_rate"), 20, 10)))
_add("mom_20_neutral", "daily_adj", neutral(change(close, 20)))
_add("price_volume_corr_20_neutral", "daily_adj", neutral(price_volume_corr))
_add("volatility_20_neutral", "daily_adj", -neutral(std(change(close, 1), 20, 10)))
_add("limit_up_consecutive_neutral", "limit_up", neutral(col("consecutive_days")))
for name in ("roe", "roa", "gross_margin"):
    _add(f"{name}_neutral", "financial_indicator", neutral(col(name)), "financial_indicator", "calendar")
_add("fcf_yield_neutral", "cashflow_finance", neutral(col("free_cashflow") / positive(col("total_mv"))), "cashflow", "finance", "calendar")
