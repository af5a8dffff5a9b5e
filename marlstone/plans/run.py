"""Batches of factors: decide, build what is due in as few passes as there are panels, and store."""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterable

from pyspark.sql import functions as F

from marlstone.factors import get_factor, ordered_names
from marlstone.plans.build import build
from marlstone.plans.planner import Decision, dated_inputs, decide, effective_end, lag_days, scan_start, source_dates
from marlstone.plans.store import FactorStore
from marlstone.sources.catalog import Catalog


def plan(catalog: Catalog, store: FactorStore, names: Iterable[str], now: dt.datetime, force: bool = False) -> dict[str, Decision]:
    """A decision for each factor, in building order."""
    names = ordered_names(list(names))
    inputs = sorted({i for n in names for i in dated_inputs(get_factor(n))})
    dates = source_dates({i: catalog.table(i) for i in inputs}) if inputs else {}
    end = effective_end(dates.get("daily_adj"), now)
    out = {}
    for n in names:
        info = store.info(n)
        built = dt.date.fromisoformat(info["last_date"]) if info and info.get("last_date") not in (None, "None") else None
        out[n] = decide(built, {i: dates[i] for i in dated_inputs(get_factor(n))}, end, force)
    return out


def run(catalog: Catalog, store: FactorStore, names: Iterable[str], now: dt.datetime, force: bool = False) -> dict[str, str]:
    """Build and store what is due; the action taken by name.

    What is rebuilt is one plan and one write. So is what is brought up to date,
    whose inputs are read only from where its windows reach back to.
    """
    decisions = plan(catalog, store, names, now, force)
    rebuilt = [n for n, d in decisions.items() if d.action == "rebuild"]
    if rebuilt:
        store.write_all(build(catalog, rebuilt), rebuilt)
    added = [n for n, d in decisions.items() if d.action == "incremental"]
    if added:
        first = {n: decisions[n].start - dt.timedelta(days=lag_days(get_factor(n))) for n in added}
        scans = [scan_start(get_factor(n), first[n]) for n in added]
        since = None if None in scans else min(scans)
        starts = F.create_map(*[F.lit(x) for n in added for x in (n, first[n])])
        values = build(catalog.since(since), added)
        store.add_all(values.where(F.col("date") >= starts[F.col("factor")]), added)
    return {n: d.action for n, d in decisions.items()}


def slowest(seconds: dict[str, float], most: int = 5) -> list[tuple[str, float]]:
    """The names that took longest, first the longest."""
    return sorted(seconds.items(), key=lambda x: (-x[1], x[0]))[:most]


def run_each(catalog: Catalog, store: FactorStore, names: Iterable[str], now: dt.datetime, force: bool = False) -> dict[str, float]:
    """Build what is due one by one, where it matters how long each takes: the seconds by name."""
    seconds = {}
    for n, d in plan(catalog, store, names, now, force).items():
        if d.action != "skip":
            start = time.monotonic()
            run(catalog, store, [n], now, force)
            seconds[n] = time.monotonic() - start
    return seconds
