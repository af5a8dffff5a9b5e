"""Building factors: those of one panel are lowered together, then ranked together in long form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.factors import FactorSpec, get_factor, ordered_names
from marlstone.functions.signal import Sig, average_rank, cross_rank, quantised, with_signals
from marlstone.sources.catalog import Catalog


def compute(catalog: Catalog, name: str) -> DataFrame:
    """(date, code, value) of one factor."""
    spec = get_factor(name)
    out = with_signals(catalog.panel(spec.panel), {"value": spec.signal})
    return _trimmed(out, spec).select("date", "code", "value")


def _trimmed(df: DataFrame, spec: FactorSpec) -> DataFrame:
    if not spec.trim:
        return df
    return df.withColumn("_later", _later(spec.trim)).where("_later").drop("_later")


def _later(rows: int) -> Column:
    """Has the code so many rows after this one?"""
    return F.lead("date", rows).over(Window.partitionBy("code").orderBy("date")).isNotNull()


def _raw(signal: Sig) -> Sig | None:
    """What is ranked, if a signal is the plain rank of something winsorised."""
    if signal.op == "pct_rank" and len(signal.args) == 1 and signal.args[0].op == "winsor":
        inner = signal.args[0].args[0]
        return inner if cross_rank(inner) == signal else None
    return None


def rank_long(raw: DataFrame, lower: float = 0.01, upper: float = 0.99) -> DataFrame:
    """(factor, date, code, value): raw values winsorised and ranked per factor and date, all in one exchange; as they are where not ``ranked``."""
    w = Window.partitionBy("factor", "date")
    rows = raw.withColumn("_x", F.when(F.col("ranked"), quantised(F.col("raw"))))
    rows = rows.withColumn("_q", F.percentile("_x", F.array(F.lit(lower), F.lit(upper))).over(w))
    rows = rows.withColumn("_v", F.when(F.col("_x").isNotNull(), quantised(F.least(F.greatest("_x", F.col("_q")[0]), F.col("_q")[1]))))
    v = F.col("_v")
    by = w.orderBy(v.asc_nulls_last())
    share = average_rank(v, by) / F.count(v).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.select("factor", "date", "code", F.when(F.col("ranked"), share).otherwise(F.col("raw")).alias("value"))


def build(catalog: Catalog, names: list[str] | None = None) -> DataFrame:
    """(factor, date, code, value) of many factors: one pass over each panel, however many factors and labels it has, and one exchange to rank them."""
    by_panel: dict[str, list[FactorSpec]] = {}
    for n in ordered_names(names):
        spec = get_factor(n)
        by_panel.setdefault(spec.panel, []).append(spec)
    parts = []
    for panel, specs in by_panel.items():
        raws = {s.name: _raw(s.signal) for s in specs}
        wide = with_signals(catalog.panel(panel), {s.name: raws[s.name] or s.signal for s in specs})
        wide = wide.withColumns({f"_later{n}": _later(n) for n in sorted({s.trim for s in specs if s.trim})})
        one = lambda s: F.struct(
            F.lit(s.name).alias("factor"), F.col(s.name).alias("raw"), F.lit(raws[s.name] is not None).alias("ranked"), (F.col(f"_later{s.trim}") if s.trim else F.lit(True)).alias("kept")
        )
        parts.append(wide.select("date", "code", F.inline(F.array(*map(one, specs)))).where("kept").drop("kept"))
    return rank_long(reduce(DataFrame.unionByName, parts))
