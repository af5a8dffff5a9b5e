"""Ratios of statement items, as of each day."""

from marlstone.factors.registry import factor
from marlstone.functions.signal import absolute, change, clip, col, std, zero_if_null


def _one(name, statement, raw, description=""):
    factor(name, "financial", statement, raw, (statement, "calendar"), description)


def _joined(name, panel, raw, *inputs, description=""):
    factor(name, "financial", panel, raw, (*inputs, "calendar"), description)


_of = lambda a, b: col(a) / col(b)

_one("goodwill_risk", "balancesheet", -_of("goodwill", "total_hldr_eqy_exc_min_int"))
_one("inventory_pressure", "balancesheet", -_of("inventories", "total_assets"))
_one("receivable_pressure", "balancesheet", -_of("accounts_receiv", "total_assets"))
_one("fix_asset_ratio", "balancesheet", -_of("fix_assets", "total_assets"))
_one("cash_to_assets", "balancesheet", _of("money_cap", "total_assets"))
_one("short_term_debt_ratio", "balancesheet", -_of("st_borr", "total_assets"))
_one("intan_assets_ratio", "balancesheet", -_of("intan_assets", "total_assets"))

_one("operating_profit_purity", "income", clip(_of("operate_profit", "total_profit"), -1, 2))
_one("rd_intensity", "income", _of("rd_exp", "revenue"))
_one("expense_control", "income", -(zero_if_null(col("sell_exp")) + zero_if_null(col("admin_exp")) + zero_if_null(col("fin_exp"))) / col("revenue"))
_one("invest_income_reliance", "income", -clip(_of("invest_income", "operate_profit"), -5, 5))
_one("non_oper_profit_ratio", "income", -clip(absolute(zero_if_null(col("non_oper_income")) + zero_if_null(col("non_oper_exp"))) / absolute(col("total_profit")), 0, 2))
_one("credit_impair_risk", "income", -clip(absolute(col("credit_impair_loss")) / absolute(col("operate_profit")), 0, 1))
_one("assets_impair_risk", "income", -clip(absolute(col("assets_impair_loss")) / absolute(col("operate_profit")), 0, 1))

_one("ncf_act_to_revenue", "cashflow", _of("n_cashflow_act", "c_inf_fr_operate_a"), "over the operating cash inflow")
_one("financing_dependency", "cashflow", -clip(_of("n_cash_flows_fnc_act", "n_cashflow_act"), -3, 3))

_one("holder_num_change", "holder_number", -change(col("holder_num"), 63), "63 rows of the calendar")
factor("pledge_ratio", "financial", "pledge_stat", -col("pledge_ratio"), ("pledge_stat", "calendar"), "as of the period's end")
_one("gross_margin_stability_8q", "financial_indicator", -std(col("q_gsprofit_margin"), 504, 126), "over daily rows")

_joined("fcf_yield", "cashflow_finance", _of("free_cashflow", "total_mv"), "cashflow", "finance")
_joined(
    "cash_conversion_cycle", "indicator_balancesheet_income",
    -clip(col("invturn_days") + col("arturn_days") - col("acct_payable") / (col("oper_cost") / 365), -1000, 1000),
    "financial_indicator", "balancesheet", "income",
)
_joined("contract_liab_ratio", "balancesheet_income", _of("contract_liab", "revenue"), "balancesheet", "income")
_joined("investment_intensity", "cashflow_balancesheet", _of("n_cashflow_inv_act", "total_assets"), "cashflow", "balancesheet")
_joined("depr_amort_to_revenue", "cashflow_income", -(zero_if_null(col("depr_fa_coga_dpba")) + zero_if_null(col("amort_intang_assets"))) / col("revenue"), "cashflow", "income")
