"""Screening: facts, prices and sectors as of every date, filtered, scored, ranked and weighted in one plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscope.functions.normalize import composite, zscores
from equiscope.operators.asof import facts_as_of, pivoted, universe_as_of
from equiscope.operators.portfolio import by_score, equal_weight, inverse_vol_weight, top_n
from equiscope.operators.rolling import FEATURES, features_as_of
from equiscope.operators.signals import FILTERS, SIGNALS, SpecError, apply_filters, normalized_weights, with_signals
from equiscope.sources.schemas import FIELDS


@dataclass(frozen=True)
class Spec:
    """What to rank by and how to hold it; unknown keys of a mapping raise."""

    name: str = "base"
    signals: dict[str, float] = field(default_factory=lambda: {"momentum_12m": 0.6, "quality_score": 0.4})
    filters: tuple[tuple[str, dict], ...] = (("market_cap", {"min_cap": 1e6}), ("volume", {"min_avg_volume": 10.0}), ("low_volatility", {"min_vol": 0.01}))
    top_n: int = 10
    max_per_sector: int = 0
    weighting: str = "equal"
    hold_bonus: float = 0.0
    position_stop_loss: float = 0.0
    portfolio_stop_loss: float = 0.0
    momentum_cap: float = 0.0
    cost_bps: float = 10.0

    @classmethod
    def of(cls, spec: dict) -> Spec:
        if extra := set(spec) - {f.name for f in fields(cls)}:
            raise SpecError(f"unknown keys {sorted(extra)}")
        out = cls(**spec)
        normalized_weights(out.signals)
        if out.weighting not in ("equal", "inverse_vol"):
            raise SpecError(f"no weighting named {out.weighting}")
        return out

    def chain(self) -> list[tuple[str, dict]]:
        return [*([("momentum_cap", {"cap": self.momentum_cap})] if self.momentum_cap else []), *self.filters]


def screening_frame(facts: DataFrame, bars: DataFrame, sectors: DataFrame, dates: list[date], universe: DataFrame | None = None, load_from: date | None = None, parts: int | None = None) -> DataFrame:
    """(as_of, ticker, fields, close, avg_volume_20d, sector, features): rows are the tickers with any fact at the date.

    Facts go long to wide after the as-of intervals are sampled; market close and volume replace stored ones. With a universe
    (as_of, ticker), only its names. What was observed after the last date is not read on.
    """
    seen = facts.filter(F.col("observed_at") <= F.lit(max(dates)).cast("timestamp"))
    return framed(pivoted(facts_as_of(seen, dates, parts), ["as_of", "ticker"], FIELDS), bars, sectors, dates, universe, load_from)


def framed(known: DataFrame, bars: DataFrame, sectors: DataFrame, dates: list[date], universe: DataFrame | None = None, load_from: date | None = None) -> DataFrame:
    """The screening frame of facts that are wide already, as facts.filings_known gives them."""
    if universe is not None:
        known = known.join(universe, ["as_of", "ticker"], "left_semi")
    return with_market(known, features_as_of(bars, dates, load_from), sectors)


def with_market(known: DataFrame, features: DataFrame, sectors: DataFrame) -> DataFrame:
    """What is known with the features and the sector of its tickers."""
    market = features.select("as_of", "ticker", "close", "avg_volume_20d", *FEATURES)
    return known.join(market, ["as_of", "ticker"], "left").join(sectors, "ticker", "left")


def standardized(frame: DataFrame, chain: list[tuple[str, dict]], names: list[str]) -> DataFrame:
    """Rows that pass the chain with z_<signal> of each name, which depends on the rows alone."""
    kept = apply_filters(frame, chain)
    return zscores(with_signals(kept, names), {s: SIGNALS.items[s][1]["higher"] for s in names})


def scored(frame: DataFrame, spec: Spec) -> DataFrame:
    """Filtered rows with z_<signal> and composite_score."""
    weights = normalized_weights(spec.signals)
    return standardized(frame, spec.chain(), list(weights)).withColumn("composite_score", F.round(composite(weights), 9))


STRATEGY = ("strategy_id", "as_of")


STRATEGIES = "strategy_id string, chain string, signals map<string,double>, top_n int, max_per_sector int, by_vol boolean, bps double, hold_bonus double, position_stop double, portfolio_stop double"
#: strategies that meet the panel's rows in one block
BLOCK = 1000


def strategy_table(spark: SparkSession, specs: list[Spec]) -> DataFrame:
    """The strategies as rows of STRATEGIES: chain is a JSON of filter names to parameters, signals are weights that add up to 1."""
    rows = []
    for s in specs:
        filters = {name: {k: float(v) for k, v in params.items()} for name, params in s.chain()}
        for name, params in filters.items():
            FILTERS.bind(name, params)
        rows.append((s.name, json.dumps(filters, sort_keys=True), normalized_weights(s.signals), s.top_n, s.max_per_sector, s.weighting == "inverse_vol", float(s.cost_bps), float(s.hold_bonus), float(s.position_stop_loss), float(s.portfolio_stop_loss)))
    return spark.createDataFrame(rows, STRATEGIES)


def scored_by_strategy(frame: DataFrame, specs: list[Spec] | DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(strategy_id, as_of, ticker, sector, realized_vol_20d, composite_score, carry, settings): every strategy's rows.

    The strategies are a table. Its distinct filter chains and signal names, a few values, are asked for first; each chain's rows
    are standardized once, and the strategies meet them by an equi join on (chain, block), so that the plan is the same for three
    strategies and for thousands. A block of at most about BLOCK strategies is broadcast; of several, each is joined by its key.
    """
    table = specs if isinstance(specs, DataFrame) else strategy_table(frame.sparkSession, specs)
    about = table.agg(F.collect_set("chain").alias("chains"), F.array_distinct(F.flatten(F.collect_set(F.map_keys("signals")))).alias("names"), F.count(F.lit(1)).alias("n")).first()
    names, blocks = sorted(about["names"]), max(1, -(-about["n"] // BLOCK))
    normalized_weights(dict.fromkeys(names, 1.0))
    chains = {c: list(json.loads(c).items()) for c in sorted(about["chains"])}
    passes = [F.when(_passed(chain), F.lit(c)) for c, chain in chains.items()]
    day = Window.partitionBy("chain", "as_of")
    rows = frame.withColumn("chain", F.explode(F.array_compact(F.array(*passes))))
    rows = zscores(with_signals(rows, names, day), {s: SIGNALS.items[s][1]["higher"] for s in names}, day)
    rows = rows.select("chain", "as_of", "ticker", "sector", "realized_vol_20d", *carry, *(f"z_{n}" for n in names))
    if blocks == 1:
        met = rows.join(F.broadcast(table), "chain")  # at most BLOCK rows
    else:
        rows = rows.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        met = rows.join(table.withColumn("_b", F.pmod(F.hash("strategy_id"), F.lit(blocks))), ["chain", "_b"])
    score = sum((F.col(f"z_{n}") * F.coalesce(F.element_at("signals", n), F.lit(0.0)) for n in names), F.lit(0.0))
    settings = ("top_n", "max_per_sector", "by_vol", "bps", "hold_bonus")
    return met.select("strategy_id", "as_of", "ticker", "sector", "realized_vol_20d", F.round(score, 9).alias("composite_score"), *carry, *settings)


def _passed(chain: list[tuple[str, dict]]) -> Column:
    return reduce(and_, (FILTERS.bind(name, params)() for name, params in chain), F.lit(True))


def picks_by_strategy(frame: DataFrame, specs: list[Spec] | DataFrame) -> DataFrame:
    """(strategy_id, by_vol, bps, as_of, ticker, rank, target_weight): the picks of every strategy and date."""
    table = specs if isinstance(specs, DataFrame) else strategy_table(frame.sparkSession, specs)
    most = table.agg(F.coalesce(F.max("top_n"), F.lit(0)).alias("n"), F.coalesce(F.max("max_per_sector"), F.lit(0)).alias("cap")).first()
    rows = scored_by_strategy(frame, table)
    if most["cap"]:
        of_sector = F.row_number().over(Window.partitionBy(*STRATEGY, F.coalesce("sector", F.lit("__unknown__"))).orderBy(*by_score()))
        rows = rows.withColumn("_s", of_sector).filter("max_per_sector = 0 or _s <= max_per_sector")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*STRATEGY).orderBy(*by_score())))
    rows = rows.filter((F.col("rank") <= most["n"]) & (F.col("rank") <= F.col("top_n")))
    weight = F.when(F.col("by_vol"), inverse_vol_weight(keys=STRATEGY)).otherwise(equal_weight(STRATEGY))
    return rows.select("strategy_id", "by_vol", "bps", "as_of", "ticker", "rank", weight.alias("target_weight"))


def weighted(picks: DataFrame, weighting: str, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    return picks.withColumn("target_weight", equal_weight(keys) if weighting == "equal" else inverse_vol_weight(keys=keys))


def screen(frame: DataFrame, spec: Spec) -> DataFrame:
    """The picks of every date with rank and target_weight."""
    return weighted(top_n(scored(frame, spec), spec.top_n, spec.max_per_sector), spec.weighting)


def candidates(frame: DataFrame, spec: Spec, least: int = 50, times: int = 5) -> DataFrame:
    """The picks of a wider screen, from which a live account may skip names that it can't trade: max(least, times x top_n) of them."""
    return screen(frame, replace(spec, top_n=max(least, times * spec.top_n)))


def index_universe(members: DataFrame, index: str, bars: DataFrame, dates: list[date]) -> DataFrame:
    return universe_as_of(members.filter(F.col("index_name") == index), bars, dates)


def view(picks: DataFrame, n: int) -> DataFrame:
    """The result columns that exist, best first."""
    cols = ["as_of", "ticker", "composite_score", "target_weight", *(c for c in picks.columns if c.startswith("z_"))]
    return picks.select(*(c for c in cols if c in picks.columns)).orderBy(F.desc("composite_score"), "ticker").limit(n)
