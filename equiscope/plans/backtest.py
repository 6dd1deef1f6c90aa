"""Backtests of many strategies over many windows at once: set-based without feedback, a fold inside the plan with it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.operators.metrics import bundle
from equiscope.operators.portfolio import by_score, portfolio_returns, turnover
from equiscope.plans.screen import STRATEGY, Spec, picks_by_strategy, scored_by_strategy, strategy_table
from equiscope.sources.stage import compiled

#: a window of its own for a backtest: (name, start, end); every one opens empty and forgets what another held
Span = tuple[str, date, date]
Specs = list[Spec] | DataFrame
PERIOD = "struct<t:int,as_of:date,ret:double,n:int,swaps:int,cost:double,stopped:int>"


def calendar_frame(like: DataFrame, dates: list[date]) -> DataFrame:
    return like.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(dates, dates[1:], strict=False))], "t int, as_of date, next_as_of date")


def run_calendar(like: DataFrame, dates: list[date], spans: list[Span]) -> DataFrame:
    """(run, t, as_of, next_as_of): the periods of each span on the grid of dates, t from 0; a span's last date only ends its last period.

    A span that does not start and end on the grid raises: its own calendar would have other periods.
    """
    at = {d: i for i, d in enumerate(dates)}
    rows = []
    for name, start, end in spans:
        if start not in at or end not in at:
            raise ValueError(f"run {name}: {start} to {end} is not on the calendar")
        own = dates[at[start] : at[end] + 1]
        rows += [(name, i, a, b) for i, (a, b) in enumerate(zip(own, own[1:], strict=False))]
    return like.sparkSession.createDataFrame(rows, "run string, t int, as_of date, next_as_of date")


def whole(dates: list[date]) -> list[Span]:
    return [("", dates[0], dates[-1])]


def _table(like: DataFrame, specs: Specs) -> DataFrame:
    return specs if isinstance(specs, DataFrame) else strategy_table(like.sparkSession, specs)


def without_feedback(frame: DataFrame, returns: DataFrame, dates: list[date], specs: Specs, spans: list[Span] | None = None) -> DataFrame:
    """(strategy_id, run, t, as_of, ret, n, swaps, cost) of strategies whose picks don't depend on what was held; run only with spans.

    A period without picks returns 0; one whose picks have no price at all returns minus its cost. The picks, a few rows a date
    and strategy, are written once and read by the returns and by the turnover; a span pays for its first purchase again.
    """
    table, cal = _table(frame, specs), run_calendar(frame, dates, spans or whole(dates))
    picks = compiled(picks_by_strategy(frame.filter(F.col("as_of") < F.lit(dates[-1])), table), "picks")
    keys = ("strategy_id", "bps", "by_vol")
    gross = portfolio_returns(picks, returns, keys).select(*keys, "as_of", "n", "gross")
    held = picks.join(cal.select("run", "as_of"), "as_of")
    moved = turnover(held, calendar_frame(frame, dates), 10000.0, (*keys, "run"))  # what a run holds at its end meets nothing of it
    cost = (F.col("traded") + F.when(F.col("by_vol"), F.col("drift")).otherwise(0.0)) * F.col("bps") / 10000
    net = moved.drop("n", "n_before", "cost").join(gross, [*keys, "as_of"]).withColumn("cost", cost)
    out = grid(table, cal).join(net.drop("bps", "by_vol"), ["strategy_id", "run", "as_of"], "left")
    zero = F.lit(0)
    run = ["run"] if spans else []
    return out.select("strategy_id", *run, "t", "as_of", F.coalesce(F.col("gross") - F.col("cost"), F.lit(0.0)).alias("ret"), F.coalesce("n", zero).alias("n"), F.coalesce("swaps", zero).alias("swaps"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def grid(table: DataFrame, cal: DataFrame) -> DataFrame:
    """Each strategy with every period of every span: both are parameters, a row each."""
    periods = cal.agg(F.collect_list(F.struct("run", "t", "as_of")).alias("p"))
    return table.select("strategy_id").join(periods, F.lit(True)).select("strategy_id", F.inline("p"))


def within_bonus(scores: DataFrame) -> DataFrame:
    """Names that the fold can ever pick: a score within the bonus of the n-th best of the capped selection without bonus.

    scores are rows of scored_by_strategy; windows over one strategy's date, which hold one cross-section each.
    """
    day = Window.partitionBy(*STRATEGY)
    of_sector = F.row_number().over(Window.partitionBy(*STRATEGY, F.coalesce("sector", F.lit("__unknown__"))).orderBy(*by_score()))
    rows = scores.withColumn("_open", (F.col("max_per_sector") == 0) | (of_sector <= F.col("max_per_sector")))
    rows = rows.withColumn("_k", F.count_if("_open").over(day.orderBy(*by_score()).rowsBetween(Window.unboundedPreceding, 0)))
    top = F.col("_open") & (F.col("_k") <= F.col("top_n"))
    rows = rows.withColumns({"_edge": F.min(F.when(top, F.col("composite_score"))).over(day), "_n": F.count_if(top).over(day)})
    return rows.filter((F.col("_n") < F.col("top_n")) | (F.col("composite_score") >= F.col("_edge") - F.col("hold_bonus"))).drop("_open", "_k", "_edge", "_n")


def pruned(scores: DataFrame, spec: Spec) -> DataFrame:
    """within_bonus of one strategy."""
    own = {"strategy_id": spec.name, "top_n": spec.top_n, "max_per_sector": spec.max_per_sector, "hold_bonus": float(spec.hold_bonus)}
    return within_bonus(scores.withColumns({k: F.lit(v) for k, v in own.items()})).drop(*own)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: a lambda over an array of one element binds it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def _selected(candidates: Column, held: Column) -> Column:
    """The picks of one date, best first: scores with the bonus of what is held, a cap on sectors, the first top_n."""
    bonus = lambda c: F.when(F.array_contains(held, c["ticker"]), F.col("hold_bonus")).otherwise(0.0)
    ranked = F.array_sort(F.transform(candidates, lambda c: F.struct((-(c["score"] + bonus(c))).alias("k"), *(c[n].alias(n) for n in ("ticker", "sector", "vol", "ret", "low", "start")))))

    def capped(best: Column) -> Column:
        room = lambda got, x: (F.size(got) < F.col("top_n")) & (F.size(F.filter(got, lambda y: y["sector"] == x["sector"])) < F.col("max_per_sector"))
        return F.aggregate(best, F.slice(best, 1, 0), lambda got, x: F.when(room(got, x), F.array_append(got, x)).otherwise(got))

    return let(ranked, lambda best: F.when(F.col("max_per_sector") == 0, F.slice(best, F.lit(1), F.col("top_n"))).otherwise(capped(best)))


def _weighted(picks: Column) -> Column:
    """Weights in the order of the picks: equal, or 1 / vol with the median of the usable ones for those without."""
    n = F.size(picks)
    equal = F.transform(picks, lambda p: 1.0 / n)

    def inverse(inv: Column) -> Column:
        def filled(good: Column) -> Column:
            m = F.size(good)
            median = (F.get(good, F.floor((m - 1) / 2).cast("int")) + F.get(good, F.floor(m / 2).cast("int"))) / 2
            some = lambda f: F.transform(f, lambda x: x / _total(f))
            return F.when(m > 0, let(F.transform(inv, lambda x: F.coalesce(x, median)), some)).otherwise(equal)

        return let(F.array_sort(F.filter(inv, lambda x: x.isNotNull())), filled)

    return F.when(F.col("by_vol"), let(F.transform(picks, lambda p: F.when(p["vol"] > 0, 1 / p["vol"])), inverse)).otherwise(equal)


def _period(state: Column, day: Column) -> Column:
    """The state after one period: what is held, its weights, the last return, whether any period was, and the periods so far."""
    held, before = state["held"], state["weights"]
    cash = (F.col("portfolio_stop") > 0) & state["started"] & (state["last"] < -F.col("portfolio_stop"))
    rate = F.col("bps") / 10000

    def after(ret: Column, n: Column, swaps: Column, cost: Column, stopped: Column, left: Column, weights: Column) -> Column:
        row = F.struct(day["t"].alias("t"), day["as_of"].alias("as_of"), ret.alias("ret"), n.cast("int").alias("n"), swaps.cast("int").alias("swaps"), cost.alias("cost"), stopped.cast("int").alias("stopped"))
        return F.struct(left.alias("held"), weights.alias("weights"), ret.alias("last"), F.lit(True).alias("started"), F.array_append(state["out"], row).alias("out"))

    def traded(rows: Column) -> Column:
        n, names = F.size(rows), F.transform(rows, lambda r: r["ticker"])
        change = F.size(held) + n - 2 * F.size(F.array_intersect(held, names))
        moved = lambda r: F.abs(r["w"] - F.coalesce(F.element_at(before, r["ticker"]), F.lit(0.0)))
        stays = lambda r: F.array_contains(held, r["ticker"]) & (moved(r) > 0.05 * r["w"])
        drift = F.when(F.col("by_vol") & (F.size(before) > 0), _total(F.transform(rows, lambda r: F.when(stays(r), moved(r)).otherwise(0.0)))).otherwise(0.0)
        swaps = F.when(F.size(held) > 0, F.floor(change / 2)).otherwise(F.lit(0))
        share = F.when(F.size(held) > 0, change / n).otherwise(1.0)
        weights = F.when(F.col("by_vol"), F.map_from_arrays(names, F.transform(rows, lambda r: r["w"]))).otherwise(_no_weights())

        def priced(cost: Column) -> Column:
            stopped = F.size(F.filter(rows, lambda r: r["hit"]))
            net = _total(F.transform(rows, lambda r: r["w"] * F.when(r["hit"], -F.col("position_stop")).otherwise(F.coalesce(r["ret"], F.lit(0.0)))))
            left = F.transform(F.filter(rows, lambda r: ~r["hit"]), lambda r: r["ticker"])
            full = let(cost + stopped / n * rate, lambda c: after(net - c, n, swaps + stopped, c, stopped, left, weights))
            return F.when(F.exists(rows, lambda r: r["ret"].isNotNull()), full).otherwise(after(-cost, n, swaps, cost, F.lit(0), names, weights))

        return let(share * rate + drift * rate, priced)

    def bought(picks: Column) -> Column:
        hit = lambda p: F.coalesce((F.col("position_stop") > 0) & (p["low"] < p["start"] * (1 - F.col("position_stop"))), F.lit(False))
        return let(F.zip_with(picks, _weighted(picks), lambda p, w: F.struct(p["ticker"].alias("ticker"), w.alias("w"), p["ret"].alias("ret"), hit(p).alias("hit"))), traded)

    zero = F.lit(0)
    idle = after(F.lit(0.0), zero, zero, F.lit(0.0), zero, F.slice(held, 1, 0), before)
    return F.when(cash | (F.coalesce(F.size(day["names"]), zero) <= 0), idle).otherwise(let(_selected(day["names"], held), bought))


def _no_weights() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))


def with_feedback(frame: DataFrame, returns: DataFrame, dates: list[date], specs: Specs, spans: list[Span] | None = None) -> DataFrame:
    """(strategy_id, run, t, as_of, ret, n, swaps, cost, stopped) of strategies with hold bonus or stops; run only with spans.

    Every date is scored at once and pruned of what can't be picked; what is left of each date, a few names more than the picks,
    becomes one array, and a run is a fold over its array of dates: an expression, so rows never leave the JVM. A run's row holds dates x
    (top_n + names within the bonus of the last pick) names: with n names in all and a bonus beyond their spread, dates x n,
    a few hundred thousand for a market of thousands of names.
    """
    table, cal = _table(frame, specs), run_calendar(frame, dates, spans or whole(dates))
    met = frame.join(returns.select("as_of", "ticker", "ret", "min_low", "start_price"), ["as_of", "ticker"], "left")
    rows = within_bonus(scored_by_strategy(met, table, ("ret", "min_low", "start_price")))
    name = F.struct("ticker", F.col("composite_score").alias("score"), F.coalesce("sector", F.lit("__unknown__")).alias("sector"), F.col("realized_vol_20d").alias("vol"), "ret", F.col("min_low").alias("low"), F.col("start_price").alias("start"))
    days = rows.groupBy(*STRATEGY).agg(F.collect_list(name).alias("names"))
    # a strategy without any row still has its periods
    path = grid(table, cal).join(days, list(STRATEGY), "left").groupBy("strategy_id", "run").agg(F.array_sort(F.collect_list(F.struct("t", "as_of", "names"))).alias("days"))
    start = F.struct(F.array().cast("array<string>").alias("held"), _no_weights().alias("weights"), F.lit(0.0).alias("last"), F.lit(False).alias("started"), F.array().cast(f"array<{PERIOD}>").alias("out"))
    folded = path.join(table, "strategy_id").select("strategy_id", "run", F.inline(F.aggregate("days", start, _period, lambda s: s["out"])))
    return folded if spans else folded.drop("run")


def backtest(frame: DataFrame, returns: DataFrame, dates: list[date], specs: Specs, spans: list[Span] | None = None) -> DataFrame:
    """Period returns of all strategies over all spans; only those that need it go through the fold."""
    table = _table(frame, specs)
    needs = (F.col("hold_bonus") > 0) | (F.col("position_stop") > 0) | (F.col("portfolio_stop") > 0)
    some = table.agg(F.count_if(~needs).alias("plain"), F.count_if(needs).alias("path")).first()
    parts = []
    if some["plain"]:
        parts.append(without_feedback(frame, returns, dates, table.filter(~needs), spans))
    if some["path"]:
        parts.append(with_feedback(frame, returns, dates, table.filter(needs), spans).drop("stopped"))
    return reduce(DataFrame.unionByName, parts)


def monte_carlo_leg(specs: list[Spec], match_strategy: bool = False) -> tuple[list[Spec], list[tuple[int, float]]]:
    """(strategies to compare, legs of random portfolios to compare them with).

    By default a strategy is compared without hold bonus and stops, which random portfolios do not have; with match_strategy it
    keeps them, and its random portfolios have its position stop.
    """
    if match_strategy:
        return specs, sorted({(s.top_n, s.position_stop_loss) for s in specs})
    return [replace(s, hold_bonus=0.0, position_stop_loss=0.0, portfolio_stop_loss=0.0) for s in specs], sorted({(s.top_n, 0.0) for s in specs})


def years_between(start: date, end: date) -> float:
    return (end - start).days / 365.25


def summary(returns: DataFrame, start: date, end: date, ppy: int = 12) -> DataFrame:
    """Metric rows of a backtest from start to end, annualized by its days, with its swaps and mean cost."""
    extra = returns.groupBy("strategy_id").agg(F.sum("swaps").alias("swaps"), F.avg("cost").alias("mean_cost"))
    return bundle(returns.select("strategy_id", "t", "ret"), ppy, years=years_between(start, end)).join(extra, "strategy_id")


def equal_weight_market(returns: DataFrame, dates: list[date]) -> DataFrame:
    """(t, mkt): the mean in-period return of everything that trades."""
    cal = calendar_frame(returns, dates)
    return returns.groupBy("as_of").agg(F.avg("within_ret").alias("mkt")).join(F.broadcast(cal), "as_of").select("t", "mkt")


__all__ = ["Span", "backtest", "calendar_frame", "equal_weight_market", "pruned", "run_calendar", "summary", "with_feedback", "within_bonus", "without_feedback", "years_between"]
