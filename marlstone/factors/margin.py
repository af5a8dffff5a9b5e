"""Margin balances against size and turnover."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import change, col, total

factor("margin_leverage_ratio", "margin", "margin_finance", -col("rzye") / col("circ_mv"), ("margin_detail", "finance"))
factor("margin_buy_intensity_5d", "margin", "margin_daily", total(col("rzmre"), 5, 3) / total(col("amount"), 5, 3), ("margin_detail", "daily_adj"), "windows run over the joined rows")
factor("short_sale_pressure_5d", "margin", "margin_detail", -change(col("rqye"), 5))
