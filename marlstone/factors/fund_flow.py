"""Flows of orders by size, and of margin trading."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import Sig, change, col, slope, total

SIZES = ("sm", "md", "lg", "elg")


def turnover() -> Sig:
    """All bought and sold; NULL if any part is, and zero counts as missing when divided by."""
    parts = [col(f"{side}_{size}_amount") for side in ("buy", "sell") for size in SIZES]
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def net(size: str) -> Sig:
    return col(f"buy_{size}_amount") - col(f"sell_{size}_amount")


TA = turnover()
net_ratio = col("net_mf_amount") / TA
big_net = net("lg") + net("elg")

factor("mf_net_inflow_ratio", "fund_flow", "main_fund_flow", net_ratio)
factor("mf_net_inflow_5d", "fund_flow", "main_fund_flow", total(net_ratio, 5, 3))
factor("mf_big_order_ratio", "fund_flow", "main_fund_flow", big_net / TA)
factor("mf_small_order_ratio", "fund_flow", "main_fund_flow", -net("sm") / TA)
factor("mf_big_small_divergence", "fund_flow", "main_fund_flow", (big_net - net("sm")) / TA)
factor("mf_net_inflow_trend_5d", "fund_flow", "main_fund_flow", slope(net_ratio, 5, 3))
factor("margin_buy_strength", "fund_flow", "margin_detail", (col("rzmre") - col("rzche")) / col("rzye"))
factor("margin_balance_change", "fund_flow", "margin_detail", change(col("rzye"), 1))
factor("margin_short_pressure", "fund_flow", "margin_detail", -col("rqye") / col("rzrqye"))
factor("big_order_divergence", "fund_flow", "flow_and_price_ranks", col("flow_rank") - col("price_rank"), ("main_fund_flow", "daily_adj"), "ranks are taken before the join")
