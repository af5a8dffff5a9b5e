"""Reported indicators, as of each day."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import col, pct_rank

INPUTS = ("financial_indicator", "calendar")
#: Indicators that are ranked as they are.
AS_REPORTED = (
    "roe", "roa", "roic", "roe_waa", "roe_dt", "gross_margin", "netprofit_margin", "current_ratio", "quick_ratio", "cash_ratio",
    "ocf_to_profit", "salescash_to_or", "assets_turn", "or_yoy", "netprofit_yoy", "equity_yoy", "assets_yoy", "ebit_to_interest", "inv_turn", "ar_turn",
    "q_roe", "q_gsprofit_margin", "q_netprofit_margin", "q_sales_yoy", "q_netprofit_yoy", "q_profit_yoy", "q_ocf_to_sales", "q_eps",
)
for name in AS_REPORTED:
    factor(name, "quality", "financial_indicator", col(name), INPUTS)
factor("debt_to_assets", "quality", "financial_indicator", -col("debt_to_assets"), INPUTS)
_parts = [pct_rank(col(c)) for c in ("roe", "roa", "gross_margin", "ocf_to_profit")]
factor("quality_composite", "quality", "financial_indicator", (_parts[0] + _parts[1] + _parts[2] + _parts[3]) / 4, INPUTS, ranked=False, description="mean of four ranks, NULL if any is")
