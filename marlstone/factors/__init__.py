"""The registered factors. Importing this package registers all of them."""

from marlstone.factors import enhanced, event, financial, fund_flow, margin, neutral, price, quality, sector, target, valuation  # noqa: F401
from marlstone.factors.registry import CATEGORY_ORDER, FactorSpec, all_factors, factor, get_factor, ordered_names

__all__ = ["CATEGORY_ORDER", "FactorSpec", "all_factors", "factor", "get_factor", "ordered_names"]
