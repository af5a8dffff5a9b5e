"""What to build: skip, rebuild, or add the dates that are missing. Plain functions over dates; the clock is a parameter."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame

from marlstone.factors import FactorSpec
from marlstone.sources.tables import TABLES, max_date

#: Fixed value: the hour from which the day's data count as there.
READY_HOUR = 18


@dataclass(frozen=True)
class Decision:
    action: str  # skip, rebuild or incremental
    reason: str
    start: dt.date | None = None


def effective_end(last_bar: dt.date | None, now: dt.datetime) -> dt.date:
    """The last date that data may have: the last bar's, and not today's before the data are ready."""
    latest = now.date() if now.hour >= READY_HOUR else now.date() - dt.timedelta(days=1)
    return min(last_bar, latest) if last_bar else latest


def decide(built_to: dt.date | None, sources: dict[str, dt.date | None], end: dt.date, force: bool = False) -> Decision:
    """``built_to``: the last date built, None if nothing is; ``sources``: each input's last date, dimensions left out."""
    if force:
        return Decision("rebuild", "forced")
    if built_to is None:
        return Decision("rebuild", "not built yet")
    if not sources or any(d is None for d in sources.values()):
        return Decision("skip", "a source has no last date")
    if built_to > end:
        return Decision("rebuild", f"built to {built_to}, beyond {end}")
    reach = min(*sources.values(), end)
    if built_to >= reach:
        return Decision("skip", f"built to {built_to}, sources reach {reach}")
    return Decision("incremental", f"sources reach {reach}", built_to + dt.timedelta(days=1))


def dated_inputs(spec: FactorSpec) -> list[str]:
    """A factor's inputs that have dates; dimensions say nothing of freshness."""
    return [i for i in spec.inputs if i in TABLES and TABLES[i].date is not None]


def source_dates(tables: dict[str, DataFrame]) -> dict[str, dt.date | None]:
    """Each table's last date: the day of announcement for reports, rows that were filled in left out."""
    out = {}
    for name, df in tables.items():
        column = "date" if "date" in df.columns else "ann_date" if "ann_date" in df.columns else TABLES[name].date
        out[name] = max_date(df, column).first()[0]
    return out


def lag_days(spec: FactorSpec, days_per_row: float = 1.6) -> int:
    """Days before the first new date whose values may change too: those of labels that looked ahead to it."""
    return int(spec.trim * days_per_row) + 10 if spec.trim else 0


def scan_start(spec: FactorSpec, start: dt.date, days_per_row: float = 1.6) -> dt.date | None:
    """From which date inputs are read to have a factor right from ``start``; None: from the first."""
    rows = spec.lookback
    return None if rows is None else start - dt.timedelta(days=int(rows * days_per_row) + 10)
