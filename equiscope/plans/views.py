"""The stages of a screen as SQL views, made when a statement names them."""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from equiscope.operators import asof, calendar, facts, rolling
from equiscope.plans import screen
from equiscope.plans.screen import Spec
from equiscope.sources import domain
from equiscope.sources.schemas import FIELDS

Build = Callable[["Views"], DataFrame]
STAGES: dict[str, Build] = {}


def stage(f: Build) -> Build:
    STAGES[f.__name__] = f
    return f


class Views:
    """Stages over one set of tables, dates and strategy; each is planned once, with what it needs, and nothing is computed by that."""

    def __init__(self, spark: SparkSession, sf_dir: str, start: date, end: date, spec: Spec | None = None, frequency: str = "monthly", prefix: str = ""):
        self.spark, self.sf_dir, self.spec, self.prefix = spark, sf_dir, spec or Spec(), prefix
        self.dates = calendar.rebalance_dates(start, end, frequency)
        self._made: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in STAGES:
            raise KeyError(f"no stage named {name}")
        if name not in self._made:
            self._made[name] = STAGES[name](self)
            self._made[name].createOrReplaceTempView(self.prefix + name)
        return self._made[name]

    def sql(self, statement: str) -> DataFrame:
        """A statement over the stages that it names; what they need is planned with them."""
        for word in set(re.findall(r"\w+", statement)):
            if word.startswith(self.prefix) and word[len(self.prefix) :] in STAGES:
                self[word[len(self.prefix) :]]
        return self.spark.sql(statement)


@stage
def dates(v: Views) -> DataFrame:
    rows = [(i, a, b) for i, (a, b) in enumerate(zip(v.dates, [*v.dates[1:], None], strict=True))]
    return v.spark.createDataFrame(rows, "t int, as_of date, next_as_of date")


@stage
def bars(v: Views) -> DataFrame:
    return domain.bars(v.spark, v.sf_dir)


@stage
def membership(v: Views) -> DataFrame:
    return domain.membership(v.spark, v.sf_dir)


@stage
def sectors(v: Views) -> DataFrame:
    return domain.sectors(v.spark, v.sf_dir)


@stage
def filings(v: Views) -> DataFrame:
    return domain.statements(v.spark, v.sf_dir)


@stage
def pit_facts(v: Views) -> DataFrame:
    return facts.filing_facts(v["filings"])


@stage
def known(v: Views) -> DataFrame:
    return facts.filings_known(v["filings"], v.dates, FIELDS)


@stage
def universe(v: Views) -> DataFrame:
    return asof.universe_as_of(v["membership"], v["bars"], v.dates)


@stage
def tradeable(v: Views) -> DataFrame:
    return asof.tradeable_as_of(v["bars"], v.dates)


@stage
def features(v: Views) -> DataFrame:
    return rolling.features_as_of(v["bars"], v.dates)


@stage
def panel(v: Views) -> DataFrame:
    return screen.framed(v["known"], v["bars"], v["sectors"], v.dates, v["universe"])


@stage
def returns(v: Views) -> DataFrame:
    return rolling.period_returns(v["bars"], v.dates)


@stage
def scores(v: Views) -> DataFrame:
    return screen.scored(v["panel"], v.spec)


@stage
def picks(v: Views) -> DataFrame:
    return screen.screen(v["panel"], v.spec)
