"""Signals as DuckDB SQL: the same trees, lowered to common table expressions for another engine.

Each level of windows is one table expression. The windows' definitions are
written for that engine's own functions, independent of the Spark lowering.
"""

from __future__ import annotations

from marlstone.functions.signal import DECIMALS, SIGNIFICANT, Sig


def quantised(x: str) -> str:
    scale = f"pow(10, {SIGNIFICANT - 1} - floor(log10(greatest(abs({x}), {10.0 ** (SIGNIFICANT - 1 - DECIMALS)!r}::DOUBLE))))"
    return f"(floor({x} * {scale} + 0.5) / {scale})"


class SqlText:
    def __init__(self, source: str, date: str = "date", code: str = "code") -> None:
        """source: a table or a common table expression with the panel's columns."""
        self.steps: list[str] = []
        self.source, self.date, self.code = source, date, code
        self.names: dict[Sig, str] = {}

    def _level(self, s: Sig) -> int:
        return max((self._level(c) for c in s.children), default=0) + s.windowed

    def _collect(self, s: Sig, found: dict[Sig, int]) -> None:
        for c in s.children:
            self._collect(c, found)
        if s.windowed:
            found[s] = self._level(s)

    def select(self, signals: dict[str, Sig], keys: str = "date, code", prefix: str = "s") -> tuple[list[str], str]:
        """(table expressions, final select) with the signals beside the keys."""
        found: dict[Sig, int] = {}
        for s in signals.values():
            self._collect(s, found)
        ctes, at = [], self.source
        for depth in sorted(set(found.values())):
            cols = []
            for s in (s for s, d in found.items() if d == depth):
                text = self._window(s)
                self.names[s] = name = f"w{len(self.names)}_"
                cols.append(f"{text} AS {name}")
            ctes.append(f"{prefix}{depth} AS (SELECT *, {', '.join(cols)} FROM {at})")
            at = f"{prefix}{depth}"
        exprs = ", ".join(f"{self.expr(s)} AS {n}" for n, s in signals.items())
        return ctes, f"SELECT {keys}, {exprs} FROM {at}"

    def expr(self, s: Sig) -> str:
        if s in self.names:
            return self.names[s]
        a = s.args
        c = [self.expr(x) if isinstance(x, Sig) else x for x in a]
        match s.op:
            case "col":
                return a[0]
            case "lit":
                return f"CAST({a[0]!r} AS DOUBLE)"
            case "add" | "sub" | "mul":
                return f"({c[0]} {dict(add='+', sub='-', mul='*')[s.op]} {c[1]})"
            case "div":
                return f"({c[0]} / nullif({c[1]}, 0))"
            case "neg":
                return f"(-{c[0]})"
            case "abs":
                return f"abs({c[0]})"
            case "ln":
                return f"(CASE WHEN {c[0]} > 0 THEN ln({c[0]}) END)"
            case "positive":
                return f"(CASE WHEN {c[0]} > 0 THEN {c[0]} END)"
            case "zero_if_null":
                return f"coalesce({c[0]}, 0.0)"
            case "clip":
                out = c[0]
                if a[1] is not None:
                    out = f"greatest({out}, CAST({a[1]} AS DOUBLE))"
                if a[2] is not None:
                    out = f"least({out}, CAST({a[2]} AS DOUBLE))"
                return f"(CASE WHEN {c[0]} IS NOT NULL THEN {out} END)"
            case "greatest" | "least":
                return f"{s.op}({', '.join(c)})"
            case "greatest_strict":
                return f"(CASE WHEN {' AND '.join(f'{x} IS NOT NULL' for x in c)} THEN greatest({', '.join(c)}) END)"
        raise ValueError(s.op)

    def _window(self, s: Sig) -> str:
        a = s.args
        x = self.expr(a[0])
        order = f"PARTITION BY {self.code} ORDER BY {self.date}"
        rows = lambda n: f"({order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
        so_far = f"({order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
        match s.op:
            case "pad":
                return f"last_value({x} IGNORE NULLS) OVER {so_far}"
            case "lag":
                return f"lag({x}, {a[1]}) OVER ({order})" if a[1] >= 0 else f"lead({x}, {-a[1]}) OVER ({order})"
            case "mean" | "std" | "sum" | "max" | "min":
                f = {"mean": "avg", "std": "stddev_samp"}.get(s.op, s.op)
                return f"CASE WHEN count({x}) OVER {rows(a[1])} >= {a[2]} THEN {f}({x}) OVER {rows(a[1])} END"
            case "skew" | "kurt":
                f, flat = ("skewness", 0.0) if s.op == "skew" else ("kurtosis", -3.0)
                w = rows(a[1])
                return f"CASE WHEN count({x}) OVER {w} >= {a[2]} THEN CASE WHEN max({x}) OVER {w} = min({x}) OVER {w} THEN {flat} ELSE {f}({x}) OVER {w} END END"
            case "slope":
                h = f"list_filter(list({x}) OVER {rows(a[1])}, lambda e: e IS NOT NULL)"
                m = f"CAST(len({h}) AS DOUBLE)"
                return f"CASE WHEN {m} >= {a[2]} THEN list_sum(list_transform({h}, lambda v, i: (i - 1 - ({m} - 1) / 2) * v)) / ({m} * ({m} * {m} - 1) / 12) END"
            case "history_rank":
                h = f"list_filter(list({x}) OVER {so_far}, lambda e: e IS NOT NULL)"
                return f"CASE WHEN {x} IS NOT NULL AND len({h}) >= {a[1]} THEN (len(list_filter({h}, lambda e: e < {x})) + (len(list_filter({h}, lambda e: e = {x})) + 1) / 2.0) / len({h}) END"
            case "beta":
                y, w = self.expr(a[1]), rows(a[2])
                return f"CASE WHEN count({x}) OVER {w} >= {a[3]} THEN covar_samp({x}, {y}) OVER {w} / nullif(var_samp({y}) OVER {w}, 0) END"
            case "winsor":
                r = quantised(x)
                q = lambda p: f"quantile_cont({r}, {p}) OVER (PARTITION BY {self.date})"
                return f"CASE WHEN {x} IS NOT NULL THEN least(greatest({r}, {q(a[1])}), {q(a[2])}) END"
            case "pct_rank":
                r, keys = quantised(x), ", ".join([self.date, *a[1:]])
                ties = f"count(*) OVER (PARTITION BY {keys}, {r})"
                return f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY {keys} ORDER BY {r} NULLS LAST) + ({ties} - 1) / 2.0) / count({x}) OVER (PARTITION BY {keys}) END"
        raise ValueError(s.op)
