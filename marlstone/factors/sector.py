"""A code against the sectors that it belongs to. The panels hold the averages over its sectors."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import beta, clip, col

BRIDGE = ("ths_constituent_stocks", "ths_sector_categories")

factor("sector_rel_strength_20", "sector", "sector_strength", col("stock_change") - col("sector_change"), ("daily_adj", "ths_daily", *BRIDGE))
factor("sector_momentum_20", "sector", "sector_momentum", col("sector_change"), ("daily_adj", "ths_daily", *BRIDGE), "on the dates of daily_adj, for all codes of the bridge")
factor("sector_beta_60", "sector", "sector_returns", clip(beta(col("stock_ret"), col("sector_ret"), 60, 30), -5, 5), ("daily_adj", "ths_daily", *BRIDGE))
factor("sector_mv_rank", "sector", "sector_mv_ranks", col("mean_rank"), ("finance", "ths_daily", *BRIDGE))
factor("sector_amount_rank", "sector", "sector_amount_ranks", col("mean_rank"), ("daily_adj", "ths_daily", *BRIDGE))
factor("sector_rotation_20", "sector", "sector_rotation", -col("rank_move"), ("ths_daily", *BRIDGE))
factor("sector_diversification", "sector", "sector_counts", -col("sectors"), ("daily_adj", *BRIDGE), "the number of sectors on every date")
