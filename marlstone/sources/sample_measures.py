"""What stands in for market data: measures computed from the driver's tables.

Each is an expression that both engines read alike, over exact integers: ``c``
is a number of cents. Some give zeros, negatives and NULLs on purpose.
"""

from __future__ import annotations

from marlstone.sources.catalog import REPORT_COLUMNS


def _d(expr: str, over: float = 1) -> str:
    return f"CAST({expr} AS DOUBLE) / {float(over)!r}e0"


FINANCE = {
    "pb": _d("c % 97", 10),
    "ps_ttm": _d("c % 89", 7),
    "dv_ttm": f"CASE WHEN c % 11 = 0 THEN NULL ELSE {_d('c % 53', 100)} END",
    "dv_ratio": _d("c % 59", 100),
    "total_mv": _d("bal"),
    "circ_mv": _d("bal * 6", 10),
    "free_share": _d("c % 1013"),
    "total_share": _d("c % 1709"),
    "turnover_rate": f"CASE WHEN c % 13 = 0 THEN NULL ELSE {_d('c % 311', 10)} END",
    "turnover_rate_f": _d("c % 211", 10),
    "volume_ratio": _d("c % 37", 10),
    "pe_ttm_percentile": _d("c % 101"),
    "pe_ttm": _d("c % 401 - 100", 3),
}
_NAMES = [(t, name) for t, names in REPORT_COLUMNS.items() for name in names]
#: Statement items: each of its own modulus, a fifth NULL, and some negative.
REPORTS = {t: {} for t in REPORT_COLUMNS}
for _i, (_t, _n) in enumerate(_NAMES):
    REPORTS[_t][_n] = f"CASE WHEN (c + {_i}) % 5 = 0 THEN NULL ELSE {_d(f'c % {307 + 14 * _i} - {_i % 4 * 60}', 10)} END"
EVENTS = {
    "top_list": {"net_rate": _d("v % 211 - 90", 10), "amount_rate": _d("v % 97", 10), "l_buy": _d("v % 509"), "l_sell": _d("v % 31"), "turnover_rate": _d("v % 67", 10)},
    "limit_up": {"consecutive_days": "CAST(v % 7 AS DOUBLE)", "sealed_flow_ratio": _d("v % 83", 10), "open_count": "CAST(v % 5 AS DOUBLE)", "sealed_amount": _d("v")},
    "limit_list": {"open_times": "CAST(v % 6 AS DOUBLE)", "pct_chg": _d("v % 2001 - 1000", 100)},
}
SIZES = {"sm": "q <= 12", "md": "q > 12 AND q <= 25", "lg": "q > 25 AND q <= 37", "elg": "q > 37"}
FLOW = {f"{side}_{size}_amount": f"coalesce(sum(CASE WHEN {cond} AND l_linestatus = '{status}' THEN p END), 0)" for side, status in (("buy", "O"), ("sell", "F")) for size, cond in SIZES.items()}
MARGIN = {
    "rzye": "sum(CASE WHEN l_returnflag = 'A' THEN p END)",
    "rzmre": "sum(CASE WHEN l_returnflag = 'R' THEN p END)",
    "rzche": "sum(CASE WHEN l_returnflag = 'N' THEN p END)",
    "rqye": "sum(CASE WHEN l_linestatus = 'O' THEN p END)",
    "rzrqye": "sum(CASE WHEN l_linestatus = 'O' OR l_returnflag = 'A' THEN p END)",
}
CODES = 50
CALENDAR_START = "1996-01-01"
MARKER = "click"
