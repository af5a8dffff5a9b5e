"""Panels by name: source tables, and what is derived of several of them."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.signal import change, change_unpadded, col, pct_rank, positive, with_signals
from marlstone.factors.fund_flow import TA, big_net
from marlstone.operators import sectors as S
from marlstone.operators.asof import asof_panel
from marlstone.operators.events import INSTITUTION, seat_features
from marlstone.operators.panels import unique_by_key
from marlstone.sources.tables import load_panel, load_reports, read_table

#: The columns of statements that factors use.
REPORT_COLUMNS = {
    "financial_indicator": (
        "roe roa roic roe_waa roe_dt gross_margin netprofit_margin debt_to_assets current_ratio quick_ratio cash_ratio ocf_to_profit salescash_to_or "
        "assets_turn or_yoy netprofit_yoy equity_yoy assets_yoy ebit_to_interest inv_turn ar_turn invturn_days arturn_days q_roe q_gsprofit_margin "
        "q_netprofit_margin q_sales_yoy q_netprofit_yoy q_profit_yoy q_ocf_to_sales q_eps"
    ).split(),
    "balancesheet": "goodwill total_hldr_eqy_exc_min_int inventories total_assets accounts_receiv fix_assets acct_payable contract_liab money_cap st_borr intan_assets".split(),
    "income": "operate_profit total_profit revenue rd_exp sell_exp admin_exp fin_exp invest_income oper_cost non_oper_income non_oper_exp credit_impair_loss assets_impair_loss".split(),
    "cashflow": "free_cashflow n_cashflow_act c_inf_fr_operate_a n_cash_flows_fnc_act n_cashflow_inv_act depr_fa_coga_dpba amort_intang_assets".split(),
    "holder_number": ["holder_num"],
    "pledge_stat": ["pledge_ratio"],
}
#: The columns of event tables that factors use.
EVENT_COLUMNS = {
    "top_list": "net_rate amount_rate l_buy l_sell turnover_rate".split(),
    "limit_up": "consecutive_days sealed_flow_ratio open_count sealed_amount".split(),
    "limit_list": "open_times pct_chg".split(),
}
LIMIT_DOWN = "Z"
INDUSTRY_SECTOR = "I"
KEYS = ["date", "code"]


class Catalog:
    """Panels by name, each made once. ``table(name)`` gives source tables in the library's form."""

    #: What an institutional seat's name contains.
    marker = INSTITUTION

    def __init__(self) -> None:
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        raise NotImplementedError

    def since(self, start: dt.date | None) -> Catalog:
        """The same, of which dates before ``start`` need not be read; here all are."""
        return self

    def panel(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make(name)
        return self._made[name]

    def _make(self, name: str) -> DataFrame:
        if name in REPORT_COLUMNS:
            return asof_panel(self.table(name), self.table("calendar"), REPORT_COLUMNS[name])
        if name.endswith("_by_industry"):
            industry = self.table("stock_list").select("code", "industry").where("industry IS NOT NULL")
            return self.panel(name.removesuffix("_by_industry")).join(industry, "code")
        if name == "limit_list_z":
            return unique_by_key(self.table("limit_list").where(F.col("limit") == LIMIT_DOWN), EVENT_COLUMNS["limit_list"])
        if name in EVENT_COLUMNS:
            return unique_by_key(self.table(name), EVENT_COLUMNS[name])
        if name == "seats":
            return seat_features(self.table("dragon_tiger"), self.marker)
        made: dict[str, Callable[[], DataFrame]] = {
            "cashflow_finance": lambda: self._join("cashflow", self.panel("finance").select(*KEYS, "total_mv")),
            "balancesheet_income": lambda: self._join("balancesheet", self.panel("income")),
            "cashflow_balancesheet": lambda: self._join("cashflow", self.panel("balancesheet")),
            "cashflow_income": lambda: self._join("cashflow", self.panel("income")),
            "indicator_balancesheet_income": lambda: self._join("financial_indicator", self.panel("balancesheet")).join(self.panel("income"), KEYS),
            "margin_finance": lambda: self._join("margin_detail", self.panel("finance").select(*KEYS, "circ_mv")),
            "margin_daily": lambda: self._join("margin_detail", self.panel("daily_adj").select(*KEYS, "amount")),
            "flow_and_price_ranks": self._flow_and_price_ranks,
            "sector_strength": lambda: self._stock_change(20, "stock_change").join(self._sector_change(20, "sector_change"), KEYS),
            "sector_momentum": lambda: self._sector_change(20, "sector_change").join(self.panel("daily_adj").select("date").distinct(), "date", "left_semi"),
            "sector_returns": lambda: self._stock_change(1, "stock_ret").join(self._sector_change(1, "sector_ret"), KEYS).where("stock_ret IS NOT NULL AND sector_ret IS NOT NULL"),
            "sector_mv_ranks": lambda: self._member_ranks("finance", "total_mv"),
            "sector_amount_ranks": lambda: self._member_ranks("daily_adj", "amount"),
            "sector_rotation": lambda: S.sector_average(S.rank_moves(self.table("ths_daily")), self.bridge(), "rank_move"),
            "sector_counts": lambda: S.sector_counts(self.panel("daily_adj"), self.bridge()),
        }
        return made[name]() if name in made else self.table(name)

    def _join(self, left: str, right: DataFrame) -> DataFrame:
        return self.panel(left).join(right, KEYS)

    def bridge(self) -> DataFrame:
        """(code, sector) of the industry sectors."""
        industry = self.table("ths_sector_categories").where(F.col("type") == INDUSTRY_SECTOR).select("sector").distinct()
        return self.table("ths_constituent_stocks").select("code", "sector").distinct().join(industry, "sector", "left_semi")

    def _flow_and_price_ranks(self) -> DataFrame:
        flow = with_signals(self.panel("main_fund_flow"), {"flow_rank": pct_rank(big_net / TA)})
        price = with_signals(self.panel("daily_adj"), {"price_rank": pct_rank(col("pct_chg"))})
        return flow.select(*KEYS, "flow_rank").join(price.select(*KEYS, "price_rank"), KEYS)

    def _stock_change(self, rows: int, name: str) -> DataFrame:
        return with_signals(self.panel("daily_adj"), {name: change(col("close"), rows)}).select(*KEYS, name)

    def _sector_change(self, rows: int, name: str) -> DataFrame:
        return S.sector_average(S.sector_signals(self.table("ths_daily"), {name: change_unpadded(col("close"), rows)}), self.bridge(), name)

    def _member_ranks(self, panel: str, column: str) -> DataFrame:
        kept = with_signals(self.panel(panel), {"_kept": positive(col(column))}).select(*KEYS, F.col("_kept").alias(column))
        return S.member_ranks(kept, self.bridge(), self.table("ths_daily"), column)


class ParquetCatalog(Catalog):
    """Source tables as Parquet files under ``root``, codes of the pool if one is given."""

    def __init__(self, spark: SparkSession, root: str, pool: DataFrame | None = None, start: dt.date | None = None) -> None:
        super().__init__()
        self.spark, self.root, self.pool, self.start = spark, root, pool, start

    def since(self, start: dt.date | None) -> ParquetCatalog:
        """Daily panels are read from ``start`` on; reports and dimensions, which are small and carried forward, whole."""
        return ParquetCatalog(self.spark, self.root, self.pool, start)

    def table(self, name: str) -> DataFrame:
        from marlstone.operators.panels import normalise_code, parse_date

        if name in REPORT_COLUMNS:
            return load_reports(self.spark, self.root, name, REPORT_COLUMNS[name])
        if name in ("calendar", "stock_list", "ths_daily", "ths_constituent_stocks", "ths_sector_categories"):
            df = read_table(self.spark, self.root, name)
            renamed = {"ths_code": "sector", "index_code": "sector", "stock_code": "code", "trade_date": "date"}
            df = df.select(*[F.col(c).alias(renamed.get(c, c)) for c in df.columns if not (c == "code" and "stock_code" in df.columns)])
            if "code" in df.columns and name != "ths_sector_categories":
                df = df.withColumn("code", normalise_code(F.col("code")))
            if "date" in df.columns and df.schema["date"].dataType.typeName() == "string":
                df = df.withColumn("date", parse_date(F.col("date")))
            return df
        return load_panel(self.spark, self.root, name, self.start, pool=self.pool)
