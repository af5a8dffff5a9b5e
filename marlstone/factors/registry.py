"""Factors by name: a signal over a named panel, with what it needs and how far back it looks."""

from __future__ import annotations

from dataclasses import dataclass

from marlstone.functions.signal import Sig, cross_rank

#: The order in which categories are built; others come last, by name.
CATEGORY_ORDER = ("price", "timeseries", "valuation", "quality", "event", "fund_flow", "financial", "sector", "neutral", "index", "target", "other")


@dataclass(frozen=True)
class FactorSpec:
    """``signal`` is over the columns of ``panel`` and gives the final value."""

    name: str
    category: str
    panel: str
    inputs: tuple[str, ...]
    signal: Sig
    description: str = ""
    #: Drops a code's last rows, for labels that look ahead.
    trim: int = 0

    @property
    def lookback(self) -> int | None:
        """Rows of history that a value depends on; None: all of them."""
        return _lookback(self.signal)


_FACTORS: dict[str, FactorSpec] = {}


def register(spec: FactorSpec) -> FactorSpec:
    if spec.name in _FACTORS:
        raise ValueError(f"factor {spec.name!r} is registered already")
    _FACTORS[spec.name] = spec
    return spec


def factor(name: str, category: str, panel: str, raw: Sig, inputs: tuple[str, ...] | None = None, description: str = "", ranked: bool = True, trim: int = 0) -> FactorSpec:
    """Register a factor; unless ``ranked`` is off, its value is the percentile rank of the winsorised raw signal."""
    return register(FactorSpec(name, category, panel, inputs or (panel,), cross_rank(raw) if ranked else raw, description, trim))


def get_factor(name: str) -> FactorSpec:
    if name not in _FACTORS:
        raise KeyError(f"no factor {name!r}; known: {', '.join(sorted(_FACTORS))}")
    return _FACTORS[name]


def all_factors() -> dict[str, FactorSpec]:
    return dict(_FACTORS)


def ordered_names(names: list[str] | None = None) -> list[str]:
    """Names by category order, then by name."""
    rank = {c: i for i, c in enumerate(CATEGORY_ORDER)}
    specs = [get_factor(n) for n in (names if names is not None else _FACTORS)]
    return [s.name for s in sorted(specs, key=lambda s: (rank.get(s.category, len(rank)), s.category, s.name))]


def _lookback(s: Sig) -> int | None:
    inner = 0
    for c in s.children:
        own = _lookback(c)
        if own is None:
            return None
        inner = max(inner, own)
    if s.op in ("pad", "history_rank"):
        # a padded value is as old as the last one known, so any bound would be a guess
        return None if s.op == "history_rank" else inner + PAD_ROWS
    if s.op == "lag":
        return inner + max(0, s.args[1])
    if s.op in ("mean", "std", "sum", "max", "min", "skew", "kurt", "slope"):
        return inner + s.args[1] - 1
    if s.op == "beta":
        return inner + s.args[2] - 1
    return inner


#: Rows allowed for padding when a factor is built incrementally.
PAD_ROWS = 250
