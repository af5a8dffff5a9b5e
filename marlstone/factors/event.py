"""Factors of days on which something was listed."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import col

factor("dragon_tiger_net_rate", "event", "top_list", col("net_rate"))
factor("dragon_tiger_amount_rate", "event", "top_list", col("amount_rate"))
factor("dragon_tiger_buy_sell_ratio", "event", "top_list", col("l_buy") / col("l_sell"))
factor("top_list_turnover_intensity", "event", "top_list", col("turnover_rate"))
factor("limit_up_consecutive", "event", "limit_up", col("consecutive_days"))
factor("limit_up_sealed_flow_ratio", "event", "limit_up", col("sealed_flow_ratio"))
factor("limit_up_open_count_neg", "event", "limit_up", -col("open_count"))
factor("limit_up_sealed_amount", "event", "limit_up", col("sealed_amount"))
factor("limit_down_open_times", "event", "limit_list_z", col("open_times"), ("limit_list",))
factor("limit_down_pct_chg", "event", "limit_list_z", col("pct_chg"), ("limit_list",), "signed as it is")
factor("dt_org_count", "event", "seats", col("org_count"), ("dragon_tiger",))
factor("dt_top_net_rate", "event", "seats", col("top_net_share"), ("dragon_tiger",))
