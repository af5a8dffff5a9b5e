"""Signals: expressions over a panel of (date, code, measures), lowered to Spark columns.

A signal is a small immutable tree. Lowering it puts every window into a column
of its own, level by level, as Spark has no window within a window; equal
subtrees, of one signal or of many, become one column. All windows over time
are partitioned by code and ordered by date, and those over the cross section
are partitioned by date, so however many signals are lowered together, there
is one exchange by code and one by date.

Missing is NULL; division by zero and logarithms of non-positive numbers are NULL.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Union

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Number = Union[int, float]


@dataclass(frozen=True)
class Sig:
    op: str
    args: tuple = ()

    def __add__(self, other: Sig | Number) -> Sig:
        return Sig("add", (self, wrap(other)))

    def __radd__(self, other: Number) -> Sig:
        return Sig("add", (wrap(other), self))

    def __sub__(self, other: Sig | Number) -> Sig:
        return Sig("sub", (self, wrap(other)))

    def __rsub__(self, other: Number) -> Sig:
        return Sig("sub", (wrap(other), self))

    def __mul__(self, other: Sig | Number) -> Sig:
        return Sig("mul", (self, wrap(other)))

    def __truediv__(self, other: Sig | Number) -> Sig:
        return Sig("div", (self, wrap(other)))

    def __rtruediv__(self, other: Number) -> Sig:
        return Sig("div", (wrap(other), self))

    def __neg__(self) -> Sig:
        return Sig("neg", (self,))

    @property
    def children(self) -> tuple[Sig, ...]:
        return tuple(a for a in self.args if isinstance(a, Sig))

    @property
    def windowed(self) -> bool:
        return self.op in WINDOWS


def wrap(x: Sig | Number) -> Sig:
    return x if isinstance(x, Sig) else Sig("lit", (float(x),))


def col(name: str) -> Sig:
    return Sig("col", (name,))


# ---- row-wise ---------------------------------------------------------------


def absolute(x: Sig) -> Sig:
    return Sig("abs", (x,))


def log(x: Sig) -> Sig:
    return Sig("ln", (x,))


def clip(x: Sig, low: Number | None = None, high: Number | None = None) -> Sig:
    """Bounded, keeping NULL."""
    return Sig("clip", (x, low, high))


def positive(x: Sig) -> Sig:
    """NULL unless greater than zero."""
    return Sig("positive", (x,))


def zero_if_null(x: Sig) -> Sig:
    return Sig("zero_if_null", (x,))


def largest(*xs: Sig) -> Sig:
    """The largest of those that are not NULL."""
    return Sig("greatest", xs)


def smallest(*xs: Sig) -> Sig:
    return Sig("least", xs)


def largest_strict(*xs: Sig) -> Sig:
    """The largest; NULL if any is."""
    return Sig("greatest_strict", xs)


# ---- windows over time, within a code -----------------------------------------


def padded(x: Sig) -> Sig:
    """The last value that is not NULL."""
    return Sig("pad", (x,))


def lag(x: Sig, n: int) -> Sig:
    """The value n rows before; after, for negative n."""
    return Sig("lag", (x, n))


def change(x: Sig, n: int) -> Sig:
    """Relative change over n rows, NULLs padded forward first."""
    return padded(x) / lag(padded(x), n) - 1


def change_unpadded(x: Sig, n: int) -> Sig:
    return x / lag(x, n) - 1


def rolling(kind: str, x: Sig, rows: int, least: int | None = None) -> Sig:
    """mean, std, sum, max or min of the last rows; NULL with fewer than ``least`` values."""
    if least is None:
        least = 1 if kind in ("max", "min") else max(1, rows // 2)
    return Sig(kind, (x, rows, least))


def mean(x: Sig, rows: int, least: int | None = None) -> Sig:
    return rolling("mean", x, rows, least)


def std(x: Sig, rows: int, least: int | None = None) -> Sig:
    return rolling("std", x, rows, least)


def total(x: Sig, rows: int, least: int | None = None) -> Sig:
    return rolling("sum", x, rows, least)


def high(x: Sig, rows: int, least: int | None = None) -> Sig:
    return rolling("max", x, rows, least)


def low(x: Sig, rows: int, least: int | None = None) -> Sig:
    return rolling("min", x, rows, least)


def skew(x: Sig, rows: int, least: int) -> Sig:
    """Bias-corrected skewness; zero for a constant window."""
    return Sig("skew", (x, rows, max(3, least)))


def kurt(x: Sig, rows: int, least: int) -> Sig:
    """Bias-corrected excess kurtosis; -3 for a constant window."""
    return Sig("kurt", (x, rows, max(4, least)))


def slope(x: Sig, rows: int, least: int) -> Sig:
    """Least-squares slope of the window's values over 0, 1, ... with NULLs left out first."""
    return Sig("slope", (x, rows, least))


def history_rank(x: Sig, least: int) -> Sig:
    """Share of the code's own history, this row included, that is below; ties, of quantised values, count half and a half more."""
    return Sig("history_rank", (x, least))


def beta(a: Sig, b: Sig, rows: int, least: int) -> Sig:
    """Sample covariance over the second's sample variance. Rows where either is NULL are to be left out before."""
    return Sig("beta", (a, b, rows, least))


# ---- windows over the cross section, within a date ------------------------------


def winsorised(x: Sig, lower: float = 0.01, upper: float = 0.99) -> Sig:
    """Clipped to two interpolated quantiles of the date."""
    return Sig("winsor", (x, lower, upper))


def pct_rank(x: Sig, *groups: str) -> Sig:
    """Average rank over the number of values, within date and groups; NULL stays NULL."""
    return Sig("pct_rank", (x, *groups))


def cross_rank(x: Sig) -> Sig:
    """The percentile rank of the winsorised value."""
    return pct_rank(winsorised(x))


WINDOWS = {"pad", "lag", "mean", "std", "sum", "max", "min", "skew", "kurt", "slope", "history_rank", "beta", "winsor", "pct_rank"}
#: Raw values are quantised before they are compared across rows, so that ties do not hang on the order of summation:
#: to so many significant digits, and to so many decimals where those are fewer.
SIGNIFICANT, DECIMALS = 11, 12


def quantised(x: Column) -> Column:
    scale = F.pow(F.lit(10.0), SIGNIFICANT - 1 - F.floor(F.log10(F.greatest(F.abs(x), F.lit(10.0 ** (SIGNIFICANT - 1 - DECIMALS))))))
    return F.floor(x * scale + 0.5) / scale


class Lowering:
    """Lowers signals over a panel; keeps what is there already."""

    def __init__(self, panel: DataFrame, date: str = "date", code: str = "code") -> None:
        self.df, self.date, self.code = panel, date, code
        self.names: dict[Sig, str] = {}

    def level(self, s: Sig) -> int:
        return max((self.level(c) for c in s.children), default=0) + s.windowed

    def _collect(self, s: Sig, found: dict[Sig, int]) -> None:
        for c in s.children:
            self._collect(c, found)
        if s.windowed and s not in self.names:
            found[s] = self.level(s)

    def add(self, signals: dict[str, Sig]) -> DataFrame:
        """The panel with one more column per signal."""
        found: dict[Sig, int] = {}
        for s in signals.values():
            self._collect(s, found)
        for depth in sorted(set(found.values())):
            new = {}
            for s in (s for s, d in found.items() if d == depth):
                self.names[s] = name = f"_w{len(self.names)}"
                new[name] = self._window(s)
            self.df = self.df.withColumns(new)
        return self.df.withColumns({name: self.column(s) for name, s in signals.items()})

    def column(self, s: Sig) -> Column:
        if s in self.names:
            return F.col(self.names[s])
        a = s.args
        c = [self.column(x) if isinstance(x, Sig) else x for x in a]
        match s.op:
            case "col":
                return F.col(a[0])
            case "lit":
                return F.lit(a[0])
            case "add":
                return c[0] + c[1]
            case "sub":
                return c[0] - c[1]
            case "mul":
                return c[0] * c[1]
            case "div":
                return F.try_divide(c[0], F.nullif(c[1], F.lit(0.0)))
            case "neg":
                return -c[0]
            case "abs":
                return F.abs(c[0])
            case "ln":
                return F.when(c[0] > 0, F.ln(c[0]))
            case "positive":
                return F.when(c[0] > 0, c[0])
            case "zero_if_null":
                return F.coalesce(c[0], F.lit(0.0))
            case "clip":
                x, out = c[0], c[0]
                if a[1] is not None:
                    out = F.greatest(out, F.lit(float(a[1])))
                if a[2] is not None:
                    out = F.least(out, F.lit(float(a[2])))
                return F.when(x.isNotNull(), out)
            case "greatest":
                return F.greatest(*c)
            case "least":
                return F.least(*c)
            case "greatest_strict":
                return F.when(~F.array_contains(F.array(*[x.isNull() for x in c]), True), F.greatest(*c))
        raise ValueError(s.op)

    def _rows(self, n: int | None) -> Window:
        w = Window.partitionBy(self.code).orderBy(self.date)
        return w.rowsBetween(Window.unboundedPreceding if n is None else 1 - n, 0)

    def _window(self, s: Sig) -> Column:
        a = s.args
        x = self.column(a[0])
        match s.op:
            case "pad":
                return F.last(x, ignorenulls=True).over(self._rows(None))
            case "lag":
                w = Window.partitionBy(self.code).orderBy(self.date)
                return F.lag(x, a[1]).over(w) if a[1] >= 0 else F.lead(x, -a[1]).over(w)
            case "mean" | "std" | "sum" | "max" | "min":
                f = {"mean": F.avg, "std": F.stddev_samp, "sum": F.sum, "max": F.max, "min": F.min}[s.op]
                w = self._rows(a[1])
                return F.when(F.count(x).over(w) >= a[2], f(x).over(w))
            case "skew" | "kurt":
                w = self._rows(a[1])
                n = F.count(x).over(w).cast("double")
                if s.op == "skew":
                    value, flat = F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x).over(w), 0.0
                else:
                    value, flat = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6), -3.0
                return F.when(n >= a[2], F.when(F.max(x).over(w) == F.min(x).over(w), F.lit(flat)).otherwise(value))
            case "slope":
                h = F.collect_list(x).over(self._rows(a[1]))
                m = F.size(h).cast("double")
                parts = F.transform(h, lambda v, i: (i - (m - 1) / 2) * v)
                return F.when(m >= a[2], F.aggregate(parts, F.lit(0.0), lambda u, v: u + v) / (m * (m * m - 1) / 12))
            case "history_rank":
                h = F.collect_list(quantised(x)).over(self._rows(None))
                own = F.element_at(h, -1)
                below, ties = F.size(F.filter(h, lambda t: t < own)), F.size(F.filter(h, lambda t: t == own))
                return F.when(x.isNotNull() & (F.size(h) >= a[1]), (below + (ties + 1) / 2) / F.size(h))
            case "beta":
                w, y = self._rows(a[2]), self.column(a[1])
                return F.when(F.count(x).over(w) >= a[3], F.try_divide(F.covar_samp(x, y).over(w), F.nullif(F.var_samp(y).over(w), F.lit(0.0))))
            case "winsor":
                x = quantised(x)
                q = F.percentile(x, F.array(F.lit(a[1]), F.lit(a[2]))).over(Window.partitionBy(self.date))
                return F.when(x.isNotNull(), F.least(F.greatest(x, q[0]), q[1]))
            case "pct_rank":
                x = quantised(x)
                w = Window.partitionBy(self.date, *a[1:]).orderBy(x.asc_nulls_last())
                return average_rank(x, w) / F.count(x).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        raise ValueError(s.op)


def average_rank(x: Column, w: Window) -> Column:
    """The average of a value's first and last place; ``w`` is ordered by it, NULLs last. One window gives both."""
    last = F.count(x).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    return F.when(x.isNotNull(), (F.rank().over(w) + last) / 2)


def with_signals(panel: DataFrame, signals: dict[str, Sig], date: str = "date", code: str = "code") -> DataFrame:
    return Lowering(panel, date, code).add(signals)
