"""Valuation, size and turnover."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import col, log, mean, pct_rank, positive, std

RAW = {
    "bp": 1 / col("pb"),
    "sp_ttm": 1 / col("ps_ttm"),
    "dp_ttm": col("dv_ttm"),
    "log_total_mv": -log(col("total_mv")),
    "log_circ_mv": -log(col("circ_mv")),
    "float_mv_ratio": -col("free_share") / col("total_share"),
    "turnover_20": -mean(col("turnover_rate"), 20, 10),
    "turnover_f_20": -mean(col("turnover_rate_f"), 20, 10),
    "turnover_vol_20": -std(col("turnover_rate"), 20, 10),
    "volume_ratio": -col("volume_ratio"),
    "pe_ttm_percentile": -col("pe_ttm_percentile"),
    "pe_ttm": -positive(col("pe_ttm")),
}
for name, raw in RAW.items():
    factor(name, "valuation", "finance", raw)
factor("dv_composite", "valuation", "finance", (pct_rank(col("dv_ratio")) + pct_rank(col("dv_ttm"))) / 2, ranked=False, description="mean of two ranks, neither winsorised nor ranked again")
