"""The sample catalog's panels as DuckDB SQL, written apart from the Spark versions: grids and joins instead of fills and spreads."""

from __future__ import annotations

from marlstone.functions.signal import Sig, absolute, change, change_unpadded, col, lag, pct_rank
from marlstone.functions.sqltext import SqlText
from marlstone.factors import FactorSpec
from marlstone.factors.fund_flow import TA, big_net
from marlstone.sources import sample_measures as M
from marlstone.sources.catalog import EVENT_COLUMNS, REPORT_COLUMNS

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
K = "row(l_orderkey, l_linenumber, l_partkey, p)"


def _lines(unit: str) -> str:
    return f"SELECT CAST(date_trunc('{unit}', l_shipdate) AS DATE) AS date, l_suppkey AS code, l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_quantity AS q, {CENTS} AS p FROM lineitem"


def _bars(unit: str) -> str:
    close = f"arg_max(p, {K})"
    return (
        "SELECT *, (close / pre_close - 1) * 100 AS pct_chg FROM (SELECT *, lag(close) OVER (PARTITION BY code ORDER BY date) AS pre_close FROM ("
        f"SELECT date, code, CAST(arg_min(p, {K}) AS DOUBLE) AS open, CAST(CASE WHEN {close} % 97 = 0 THEN NULL ELSE {close} END AS DOUBLE) AS close, "
        f"CAST(max(p) AS DOUBLE) AS high, CAST(min(p) AS DOUBLE) AS low, sum(q) AS vol, CAST(sum(p) AS DOUBLE) AS amount FROM ({_lines(unit)}) GROUP BY date, code))"
    )


def _sums(measures: dict[str, str]) -> str:
    cols = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in measures.items())
    return f"SELECT date, code, {cols} FROM ({_lines('week')}) GROUP BY date, code"


def _flow() -> str:
    net = " ".join(("+ " if c.startswith("buy") else "- ") + c for c in M.FLOW)
    return f"SELECT *, CASE WHEN (0.0 {net}) % 23 <> 0 THEN CAST(0 {net} AS DOUBLE) END AS net_mf_amount FROM ({_sums(M.FLOW)})"


_EVENTS = "SELECT CAST(ts AS DATE) AS date, user_id AS code, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events"


def _event(name: str) -> str:
    only = {"top_list": "event_type IN ('view', 'click', 'signup')", "limit_up": "event_type IN ('purchase', 'view')", "limit_list": "event_type IN ('error', 'view', 'signup')"}[name]
    cols = ", ".join(f"max({e}) AS {n}" for n, e in M.EVENTS[name].items())
    return f"SELECT date, code, {cols} FROM ({_EVENTS}) WHERE {only} GROUP BY date, code"


def _seats() -> str:
    seats = f"SELECT date, code, CASE WHEN v % 17 = 0 THEN NULL ELSE event_type END AS org, CAST(v - 3000 AS DOUBLE) AS net FROM ({_EVENTS})"
    return (
        f"SELECT date, code, CAST(sum(CASE WHEN contains(org, '{M.MARKER}') THEN 1 ELSE 0 END) AS DOUBLE) AS org_count, "
        "sum(CASE WHEN n <= 5 THEN net END) / nullif(sum(abs(net)), 0) AS top_net_share "
        f"FROM (SELECT *, row_number() OVER (PARTITION BY date, code ORDER BY net DESC NULLS LAST) AS n FROM ({seats})) GROUP BY date, code"
    )


_ORDERS = f"SELECT o_custkey % {M.CODES} AS code, CAST(o_orderdate AS DATE) AS day, o_orderkey, o_custkey, CAST(round(o_totalprice * 100) AS BIGINT) AS p FROM orders"
_CALENDAR = f"SELECT CAST(unnest(generate_series(TIMESTAMP '{M.CALENDAR_START}', (SELECT max(CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP)) FROM orders), INTERVAL 1 DAY)) AS DATE) AS date"


def _finance() -> str:
    cols = ", ".join(f"{e} AS {n}" for n, e in M.FINANCE.items())
    return (
        f"SELECT date, code, {cols} FROM (SELECT CAST(date_trunc('week', day) AS DATE) AS date, code, CAST(sum(p) AS BIGINT) AS c, max(CAST(round(c_acctbal * 100) AS BIGINT)) AS bal "
        f"FROM ({_ORDERS}) JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"
    )


def _asof(table: str, columns: list[str]) -> str:
    """Every code on every day, joined with that day's reports, each column filled down."""
    reports = f"SELECT code, day, row(day - CAST(o_orderkey % 90 AS INTEGER), o_orderkey) AS k, {', '.join(f'{M.REPORTS[table][n]} AS {n}' for n in columns)} FROM (SELECT *, p AS c FROM ({_ORDERS}))"
    last = ", ".join(f"arg_max({n}, k) FILTER (WHERE {n} IS NOT NULL) AS {n}" for n in columns)
    fill = ", ".join(f"last_value({n} IGNORE NULLS) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}" for n in columns)
    return (
        f"SELECT date, code, {fill} FROM (SELECT g.date, g.code, {', '.join(f'r.{n}' for n in columns)} FROM (SELECT date, code FROM ({_CALENDAR}) CROSS JOIN (SELECT DISTINCT code FROM ({_ORDERS}))) g "
        f"LEFT JOIN (SELECT code, day, {last} FROM ({reports}) GROUP BY code, day) r ON g.code = r.code AND g.date = r.day)"
    )


_INDUSTRY = "SELECT s_suppkey AS code, n_regionkey AS industry FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey <> 7"
_SECTORS = f"SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_brand AS sector, CAST(max({CENTS}) AS DOUBLE) AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL"
_BRIDGE = f"SELECT l_suppkey AS code, p_brand AS sector FROM lineitem JOIN part ON l_partkey = p_partkey WHERE NOT ends_with(p_brand, '3') GROUP BY ALL HAVING CAST(sum({CENTS}) AS BIGINT) % 3 = 0"
_GRID = f"SELECT d.date, s.sector, v.close FROM (SELECT DISTINCT date FROM ({_SECTORS})) d CROSS JOIN (SELECT DISTINCT sector FROM ({_SECTORS})) s LEFT JOIN ({_SECTORS}) v ON v.date = d.date AND v.sector = s.sector"


def nested(source: str, signals: dict[str, Sig], keys: str, code: str = "code") -> str:
    """A sub-select of signals over a sub-select."""
    ctes, final = SqlText("src", code=code).select(signals, keys)
    return f"WITH {', '.join([f'src AS ({source})', *ctes])} {final}"


def _sector_average(values: str, column: str) -> str:
    return f"SELECT v.date, b.code, avg(v.{column}) AS {column} FROM ({_BRIDGE}) b JOIN ({values}) v ON v.sector = b.sector WHERE v.{column} IS NOT NULL GROUP BY v.date, b.code"


def _sector_change(rows: int, name: str) -> str:
    return _sector_average(nested(_GRID, {name: change_unpadded(col("close"), rows)}, "date, sector", "sector"), name)


def _stock_change(rows: int, name: str) -> str:
    return nested(_bars("week"), {name: change(col("close"), rows)}, "date, code")


def _member_ranks(panel: str, column: str) -> str:
    members = f"SELECT b.code, b.sector FROM ({_BRIDGE}) b WHERE b.sector IN (SELECT sector FROM ({_SECTORS})) AND b.code IN (SELECT code FROM ({panel}))"
    large = f"SELECT * FROM ({members}) WHERE sector IN (SELECT sector FROM ({members}) GROUP BY sector HAVING count(*) >= 3)"
    ranks = (
        f"SELECT p.date, p.code, (rank() OVER (PARTITION BY p.date, m.sector ORDER BY p.{column}) + (count(*) OVER (PARTITION BY p.date, m.sector, p.{column}) - 1) / 2.0) "
        f"/ count(*) OVER (PARTITION BY p.date, m.sector) AS r FROM ({panel}) p JOIN ({large}) m ON m.code = p.code WHERE p.{column} > 0"
    )
    plain = f"SELECT date, code, CASE WHEN {column} > 0 THEN {column} END AS mean_rank FROM ({panel}) WHERE NOT EXISTS (SELECT 1 FROM ({large}))"
    return f"SELECT date, code, avg(r) AS mean_rank FROM ({ranks}) GROUP BY date, code UNION ALL {plain}"


def panel(name: str, columns: list[str] | None = None) -> str:
    """A panel as a select; of reports, just the columns asked for."""
    want = lambda t: [c for c in REPORT_COLUMNS[t] if columns is None or c in columns]
    if name in REPORT_COLUMNS:
        return _asof(name, want(name))
    if name.endswith("_by_industry"):
        return f"SELECT * FROM ({panel(name.removesuffix('_by_industry'), columns)}) JOIN ({_INDUSTRY}) USING (code)"
    if name == "limit_list_z":
        return _event("limit_list")
    if name in EVENT_COLUMNS:
        return _event(name)
    both = lambda a, b: f"SELECT * FROM ({a}) JOIN ({b}) USING (date, code)"
    ranks = (nested(_flow(), {"flow_rank": pct_rank(big_net / TA)}, "date, code"), nested(_bars("week"), {"price_rank": pct_rank(col("pct_chg"))}, "date, code")) if name == "flow_and_price_ranks" else None
    move = col("close") / lag(col("close"), 20) - 1
    made = {
        "daily": lambda: _bars("week"),
        "daily_adj": lambda: _bars("week"),
        "kline_adj_weekly": lambda: _bars("week"),
        "kline_adj_monthly": lambda: _bars("month"),
        "finance": _finance,
        "main_fund_flow": _flow,
        "margin_detail": lambda: _sums(M.MARGIN),
        "seats": _seats,
        "cashflow_finance": lambda: both(panel("cashflow", columns), f"SELECT date, code, total_mv FROM ({_finance()})"),
        "balancesheet_income": lambda: both(panel("balancesheet", columns), panel("income", columns)),
        "cashflow_balancesheet": lambda: both(panel("cashflow", columns), panel("balancesheet", columns)),
        "cashflow_income": lambda: both(panel("cashflow", columns), panel("income", columns)),
        "indicator_balancesheet_income": lambda: both(both(panel("financial_indicator", columns), panel("balancesheet", columns)), panel("income", columns)),
        "margin_finance": lambda: both(_sums(M.MARGIN), f"SELECT date, code, circ_mv FROM ({_finance()})"),
        "margin_daily": lambda: both(_sums(M.MARGIN), f"SELECT date, code, amount FROM ({_bars('week')})"),
        "flow_and_price_ranks": lambda: both(*ranks),
        "sector_strength": lambda: both(_stock_change(20, "stock_change"), _sector_change(20, "sector_change")),
        "sector_momentum": lambda: f"SELECT * FROM ({_sector_change(20, 'sector_change')}) WHERE date IN (SELECT date FROM ({_bars('week')}))",
        "sector_returns": lambda: f"SELECT * FROM ({both(_stock_change(1, 'stock_ret'), _sector_change(1, 'sector_ret'))}) WHERE stock_ret IS NOT NULL AND sector_ret IS NOT NULL",
        "sector_mv_ranks": lambda: _member_ranks(_finance(), "total_mv"),
        "sector_amount_ranks": lambda: _member_ranks(_bars("week"), "amount"),
        "sector_rotation": lambda: _sector_average(nested(_GRID, {"rank_move": absolute(pct_rank(move) - pct_rank(lag(move, 20)))}, "date, sector", "sector"), "rank_move"),
        "sector_counts": lambda: (
            f"SELECT d.date, c.code, CAST(coalesce(n.k, 0) AS DOUBLE) AS sectors FROM (SELECT DISTINCT date FROM ({_bars('week')})) d CROSS JOIN (SELECT DISTINCT code FROM ({_bars('week')})) c "
            f"LEFT JOIN (SELECT code, count(DISTINCT sector) AS k FROM ({_BRIDGE}) GROUP BY code) n ON n.code = c.code"
        ),
    }
    return made[name]()


def _columns(s: Sig) -> set[str]:
    return {s.args[0]} if s.op == "col" else set().union(*[_columns(c) for c in s.children]) if s.children else set()


def factor_sql(spec: FactorSpec) -> str:
    """(date, code, value) of a factor, as text dates and rounded values."""
    ctes, final = SqlText("panel").select({"value": spec.signal})
    trim = f" WHERE n_ > {spec.trim}" if spec.trim else ""
    count = ", row_number() OVER (PARTITION BY code ORDER BY date DESC) AS n_" if spec.trim else ""
    source = f"panel AS (SELECT * FROM ({panel(spec.panel, sorted(_columns(spec.signal)))}))"
    return f"WITH {', '.join([source, *ctes])} SELECT strftime(date, '%Y%m%d') AS date, code, value FROM (SELECT date, code, value{count} FROM ({final})){trim}"
