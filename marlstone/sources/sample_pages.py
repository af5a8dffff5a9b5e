"""A service with rows that follow from what is asked for, to read the paged source without a network."""

from __future__ import annotations

import datetime as dt

BASE = dt.date(2024, 1, 1)


def fetch(start: dt.date | None, end: dt.date | None, page: int, size: int, code: str = "000000") -> list[dict]:
    """Three rows a day; without dates, one day's."""
    first, last = start or BASE, end or start or BASE
    days = [first + dt.timedelta(days=i) for i in range((last - first).days + 1)]
    rows = [{"day": d.isoformat(), "code": code, "k": k, "v": float((d - BASE).days * 10 + k)} for d in days for k in range(3)]
    return rows[(page - 1) * size : page * size]
