"""A paged HTTP source as a Spark data source: periods or codes are partitions, pages are read within them.

``spark.dataSource.register(PagedSource)``, then
``spark.read.format("paged").options(fetch="module:function", start=..., end=..., months=...).schema(...).load()``.
``fetch(start, end, page, size)`` returns the rows of a page as dicts; it is
named, so that each executor imports it. A range whose rows exceed
``range_rows`` is halved, unless ``split`` is false.

``by`` tells the partitions: ``months`` (the default), ``days`` (those of the
option ``dates``, as the open days of a calendar), ``quarters`` (their last days),
``codes`` (those of the option ``codes``, each over the whole span; ``fetch`` gets
``code=`` too) or ``once`` (a snapshot; start and end may be left out).

``per_minute`` bounds the requests of all partitions together: each gets an equal
share, by the number that may run at once (``concurrency``; else all of them).
"""

from __future__ import annotations

import datetime as dt
import functools
import importlib
import threading
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Rows a page, rows a range, requests a minute.
PAGE_ROWS, RANGE_ROWS, PER_MINUTE = 10_000, 100_000, 280


class TokenBucket:
    """At most ``per_minute`` calls a minute; the clock and sleep are parameters."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.most, self.clock, self.sleep = per_minute / 60, max(1.0, per_minute / 60), clock, sleep
        self.tokens, self.at, self.lock = self.most, clock(), threading.Lock()

    def take(self) -> None:
        with self.lock:
            now = self.clock()
            self.tokens = min(self.most, self.tokens + (now - self.at) * self.rate)
            self.at = now
            self.tokens -= 1
            wait = max(0.0, -self.tokens / self.rate)
        if wait:
            self.sleep(wait)


class TooMany(Exception):
    """The service asks for fewer requests."""


def with_retries(call: Callable[[], list[dict]], tries: int = 5, sleep: Callable[[float], None] = time.sleep) -> list[dict]:
    """Again after 2^k seconds, fifteen times as long if the service asks for fewer requests."""
    for k in range(tries):
        try:
            return call()
        except TooMany:
            wait = 15 * 2**k
        except OSError:
            wait = 2**k
        if k + 1 == tries:
            raise OSError(f"no answer in {tries} tries")
        sleep(wait)
    return []


def month_ranges(start: dt.date, end: dt.date, months: int = 1) -> list[tuple[dt.date, dt.date]]:
    """Calendar months from start to end, both included, the first and last cut."""
    out = []
    while start <= end:
        m = start.year * 12 + start.month - 1 + months
        after = dt.date(m // 12, m % 12 + 1, 1)
        out.append((start, min(end, after - dt.timedelta(days=1))))
        start = after
    return out


def quarter_ends(start: dt.date, end: dt.date) -> list[dt.date]:
    """The last days of quarters from start to end."""
    days = [dt.date(y, m, 31 if m in (3, 12) else 30) for y in range(start.year, end.year + 1) for m in (3, 6, 9, 12)]
    return [d for d in days if start <= d <= end]


def read_range(fetch: Callable[..., list[dict]], start: dt.date | None, end: dt.date | None, bucket: TokenBucket, page_rows: int = PAGE_ROWS, range_rows: int | None = RANGE_ROWS) -> Iterator[dict]:
    """All rows of a range, page by page; too large a range in halves."""
    rows: list[dict] = []
    page = 1
    while True:
        bucket.take()
        got = with_retries(lambda: fetch(start, end, page, page_rows))  # noqa: B023  called at once
        rows += got
        if len(got) < page_rows:
            yield from rows
            return
        if range_rows is not None and start is not None and len(rows) >= range_rows and start < end:
            middle = start + (end - start) // 2
            yield from read_range(fetch, start, middle, bucket, page_rows, range_rows)
            yield from read_range(fetch, middle + dt.timedelta(days=1), end, bucket, page_rows, range_rows)
            return
        page += 1


class Range(InputPartition):
    def __init__(self, start: dt.date | None, end: dt.date | None, code: str | None = None, per_minute: float = PER_MINUTE) -> None:
        super().__init__((start, end, code))
        self.start, self.end, self.code, self.per_minute = start, end, code, per_minute


class PagedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict) -> None:
        self.names, self.options = schema.names, dict(options)

    def partitions(self) -> list[Range]:
        o = self.options
        day = lambda k: dt.date.fromisoformat(o[k]) if o.get(k) else None
        start, end, by = day("start"), day("end"), o.get("by", "months")
        listed = lambda k: [x.strip() for x in o.get(k, "").split(",") if x.strip()]
        if by == "months":
            spans = [(a, b, None) for a, b in month_ranges(start, end, int(o.get("months", 1)))]
        elif by == "days":
            days = sorted(map(dt.date.fromisoformat, listed("dates")))
            spans = [(d, d, None) for d in days if (start is None or d >= start) and (end is None or d <= end)]
        elif by == "quarters":
            spans = [(d, d, None) for d in quarter_ends(start, end)]
        elif by == "codes":
            spans = [(start, end, c) for c in listed("codes")]
        elif by == "once":
            spans = [(start, end, None)]
        else:
            raise ValueError(f"by {by!r}: months, days, quarters, codes or once")
        at_once = max(1, min(len(spans), int(o.get("concurrency", len(spans) or 1))))
        share = float(o.get("per_minute", PER_MINUTE)) / at_once
        return [Range(*s, share) for s in spans]

    def read(self, partition: Range) -> Iterator[tuple]:
        module, _, name = self.options["fetch"].partition(":")
        fetch = getattr(importlib.import_module(module), name)
        if partition.code is not None:
            fetch = functools.partial(fetch, code=partition.code)
        bucket = TokenBucket(partition.per_minute)
        page_rows, range_rows = int(self.options.get("page_rows", PAGE_ROWS)), int(self.options.get("range_rows", RANGE_ROWS))
        if self.options.get("split", "true").lower() == "false":
            range_rows = None
        for row in read_range(fetch, partition.start, partition.end, bucket, page_rows, range_rows):
            yield tuple(row.get(n) for n in self.names)


class PagedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(schema, self.options)
