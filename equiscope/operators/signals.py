"""Filters and signals as Column builders in a registry."""

from __future__ import annotations

import inspect
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, GroupedData, Window, WindowSpec
from pyspark.sql import functions as F

from equiscope.functions.normalize import by_date, component, mean_of, minmax, over, present, shared, with_shared
from equiscope.functions.scalar import clip


class SpecError(ValueError):
    """A spec names something unknown, twice, or with parameters it does not have."""


class Registry:
    def __init__(self, kind: str):
        self.kind, self.items = kind, {}

    def add(self, name: str, **about) -> Callable:
        def put(f: Callable) -> Callable:
            if name in self.items:
                raise SpecError(f"two {self.kind}s named {name}")
            self.items[name] = (f, about)
            return f

        return put

    def bind(self, name: str, params: dict | None = None) -> Callable:
        if name not in self.items:
            raise SpecError(f"no {self.kind} named {name}")
        f, params = self.items[name][0], params or {}
        allowed = {p.name for p in inspect.signature(f).parameters.values() if p.kind is p.KEYWORD_ONLY}
        if extra := set(params) - allowed:
            raise SpecError(f"{self.kind} {name} has no parameter {sorted(extra)}")
        return lambda *args: f(*args, **params)


FILTERS, SIGNALS = Registry("filter"), Registry("signal")


@FILTERS.add("market_cap")
def market_cap(*, min_cap: float = 1e9) -> Column:
    return F.col("market_cap") >= min_cap


@FILTERS.add("volume")
def volume(*, min_avg_volume: float = 5e5) -> Column:
    return F.col("avg_volume_20d") >= min_avg_volume


@FILTERS.add("low_volatility")
def low_volatility(*, min_vol: float = 0.10) -> Column:
    return F.coalesce(F.col("realized_vol_20d"), F.lit(1.0)) >= min_vol


@FILTERS.add("momentum_cap")
def momentum_cap(*, cap: float = 1.0) -> Column:
    m = F.col("momentum_12m_return")
    return m.isNull() | (m <= cap)


def apply_filters(df: DataFrame, chain: list[tuple[str, dict]]) -> DataFrame:
    for name, params in chain:
        df = df.filter(FILTERS.bind(name, params)())
    return df


def filter_counts(df: DataFrame, chain: list[tuple[str, dict]]) -> DataFrame:
    """(as_of, step, filter, before, after, removed) of every filter of a chain, in one pass over the rows."""
    passed, counts = F.lit(True), [F.count(F.lit(1)).alias("n0")]
    for i, (name, params) in enumerate(chain, 1):
        passed = passed & F.coalesce(FILTERS.bind(name, params)(), F.lit(False))
        counts.append(F.count_if(passed).alias(f"n{i}"))
    rows = F.array(*(F.struct(F.lit(i).alias("step"), F.lit(name).alias("filter"), F.col(f"n{i - 1}").alias("before"), F.col(f"n{i}").alias("after")) for i, (name, _) in enumerate(chain, 1)))
    return df.groupBy("as_of").agg(*counts).select("as_of", F.inline(rows)).withColumn("removed", F.col("before") - F.col("after"))


def _z(name: str, **how) -> tuple[Column, Column]:
    return present(name, how.get("w")), component(name, **how)


@SIGNALS.add("piotroski_f", higher=True)
def piotroski_f(w: WindowSpec | None = None) -> Column:
    w = w or by_date()
    v = lambda name, fill=0.0: F.coalesce(F.col(name), F.lit(fill))
    here = lambda *names: [present(n, w) for n in names]
    checks = [
        (here("roa"), v("roa") > 0), (here("roic", "roa"), v("roic") > v("roa")), (here("fcf_yield"), v("fcf_yield") > 0),
        (here("earnings_yield"), v("earnings_yield") > 0), (here("current_ratio"), v("current_ratio") > 1.0),
        (here("net_debt_to_ebitda"), v("net_debt_to_ebitda", 5.0) < 2.0), (here("roe"), v("roe") > over(F.median(v("roe")), w)),
        (here("gross_margin_current", "gross_margin_prior"), v("gross_margin_current") > v("gross_margin_prior")),
    ]
    total = F.lit(0.0)
    for there, ok in checks:
        for t in there:
            ok = ok & t
        total = total + ok.cast("double")
    return total / 8.0


@SIGNALS.add("momentum_12m", higher=True)
def momentum_12m(w: WindowSpec | None = None) -> Column:
    """The 12-month return where the date has any, else revenue growth, else the standardized close."""
    w = w or by_date()
    std = over(F.stddev_samp("close"), w)
    close = F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise((F.col("close") - over(F.avg("close"), w)) / std)
    return F.when(present("momentum_12m_return", w), F.coalesce("momentum_12m_return", F.lit(0.0))).when(present("revenue_growth", w), F.col("revenue_growth")).otherwise(close)


@SIGNALS.add("low_leverage_growth", higher=True)
def low_leverage_growth(w: WindowSpec | None = None) -> Column:
    return mean_of([_z("momentum_12m_return", w=w), _z("net_debt_to_ebitda", invert=True, w=w), _z("fcf_yield", w=w), _z("capex_to_revenue", invert=True, bounds=(0.0, 0.5), w=w)])


def _debt(w: WindowSpec) -> tuple[Column, Column]:
    nd, de = present("net_debt_to_ebitda", w), present("debt_to_equity", w)
    return nd | de, F.when(nd, component("net_debt_to_ebitda", invert=True, w=w)).otherwise(component("debt_to_equity", invert=True, w=w))


def _quality(w: WindowSpec) -> list[tuple[Column, Column]]:
    return [*(_z(c, w=w) for c in ("roe", "roic", "roa")), _debt(w), _z("rd_to_revenue", bounds=(0.0, 0.4), w=w)]


@SIGNALS.add("quality_score", higher=True)
def quality_score(w: WindowSpec | None = None) -> Column:
    return mean_of([*_quality(w), _z("earnings_stability", fill=0.5, w=w)])


@SIGNALS.add("quality_midcap", higher=True)
def quality_midcap(w: WindowSpec | None = None) -> Column:
    return mean_of([*_quality(w), _z("earnings_yield", w=w), _z("earnings_stability", fill=0.5, w=w)])


@SIGNALS.add("margin_expansion", higher=True)
def margin_expansion(w: WindowSpec | None = None) -> Column:
    def change(a: str, b: str, most: float) -> tuple[Column, Column]:
        zero = F.lit(0.0)
        return present(a, w) & present(b, w), minmax(clip(F.coalesce(F.col(a), zero) - F.coalesce(F.col(b), zero), -most, most), w)

    return mean_of([change("gross_margin_current", "gross_margin_prior", 0.2), change("op_margin_current", "op_margin_prior", 0.2), change("sga_to_revenue_prior", "sga_to_revenue", 0.15)])


@SIGNALS.add("quality_at_discount_midcap", higher=True)
def quality_at_discount_midcap(w: WindowSpec | None = None) -> Column:
    return mean_of([_z("gross_margin_current", w=w), _z("momentum_12m_return", invert=True, w=w), _z("fcf_yield", w=w), _z("net_debt_to_ebitda", invert=True, w=w)])


def with_signals(df: DataFrame, names: list[str], w: WindowSpec | None = None) -> DataFrame:
    with shared() as made:
        cols = {n: SIGNALS.bind(n)(w) for n in names}
    return with_shared(df, made, cols)


def normalized_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if total <= 0:
        raise SpecError("signal weights add up to nothing")
    for n in weights:
        if n not in SIGNALS.items:
            raise SpecError(f"no signal named {n}")
    return {n: v / total for n, v in weights.items()}


def python_signal(df: DataFrame, name: str, compute: Callable, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """A signal that can't be an expression: compute(pandas frame of one date) -> values. A group is one cross-section."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.DoubleType())])
    groups: GroupedData = df.groupBy(*keys)
    return groups.applyInPandas(lambda p: p.assign(**{name: compute(p)}), schema)


__all__ = ["FILTERS", "SIGNALS", "Registry", "SpecError", "Window", "apply_filters", "filter_counts", "normalized_weights", "python_signal", "with_signals"]
