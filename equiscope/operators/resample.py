"""Monte Carlo portfolios and block bootstrap with hash draws, so that any engine can replay them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import EULER_GAMMA, draw, normal_ppf, per_period_sharpe
from equiscope.operators.metrics import cagr, equity, psr, sharpe


Leg = tuple[int, float]


def drawn_places(periods: DataFrame, iterations: int, most: int, seed: int = 42) -> DataFrame:
    """(iteration, as_of, size, k, place): for each iteration and date the first `most` places of a cross-section of `size` names.

    periods are (as_of, size). Of a large cross-section places are drawn one after the other and repeats skipped, which costs a few draws a
    place and nothing for the names that are not drawn. One of at most four times as many names as wanted, or draws that
    repeat too often, take all its places in the order of a hash. Everything happens within a row: no sort of names, no shuffle.
    """
    size, it, day = F.col("size"), F.col("iteration"), F.col("as_of")
    grid = periods.withColumn("iteration", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    grid = grid.repartition(grid.sparkSession.sparkContext.defaultParallelism, "iteration")
    some = F.transform(F.sequence(F.lit(0), F.lit(3 * most + 39)), lambda j: F.floor(draw(seed, it, day, j) * size).cast("int"))
    some = F.when(size > 4 * most, F.slice(F.array_distinct(some), 1, most))
    every = F.transform(F.sequence(F.lit(0), size - 1), lambda p: F.struct(draw(seed, it, day, F.lit("p"), p).alias("u"), p.alias("p")))
    every = F.slice(F.transform(F.array_sort(every), lambda s: s["p"]), 1, most)
    grid = grid.withColumn("_s", some)
    places = F.when(F.size("_s") >= most, F.col("_s")).when(size > 0, every)
    return grid.select("iteration", "as_of", "size", F.posexplode_outer(places).alias("k", "place"))


def random_portfolios(universe: DataFrame, returns: DataFrame, dates: list[date], legs: list[Leg], iterations: int = 500, bps: float = 10.0, ppy: int = 12, seed: int = 42) -> DataFrame:
    """(n, stop, iteration, sharpe): portfolios of n names drawn anew every period from that period's universe, for each leg (n, stop).

    A period with fewer than n names, or without a return among those drawn, gives 0 and costs nothing; else the mean of the returns that there
    are, less twice the cost. With a stop, a name whose low fell below (1 - stop) of its start returns -stop.
    All legs share the draws: the first n of the largest leg's. What moves is iterations x dates x names drawn.
    """
    most = max(n for n, _ in legs)
    day = Window.partitionBy("as_of")
    names = universe.select("as_of", "ticker").withColumn("place", F.row_number().over(day.orderBy("ticker")) - 1)
    periods = universe.sparkSession.createDataFrame([(d,) for d in dates[:-1]], "as_of date").join(universe.groupBy("as_of").agg(F.count(F.lit(1)).cast("int").alias("size")), "as_of", "left")
    drawn = drawn_places(periods.withColumn("size", F.coalesce("size", F.lit(0))), iterations, most, seed)
    own = names.join(returns.select("as_of", "ticker", "within_ret", "min_low", "start_price"), ["as_of", "ticker"]).drop("ticker")
    met = drawn.join(own, ["as_of", "place"], "left")

    def period(n: int, stop: float) -> Column:
        r = F.when(F.col("min_low") < F.col("start_price") * (1 - stop), F.lit(-stop)).otherwise(F.col("within_ret")) if stop else F.col("within_ret")
        return F.coalesce(F.when(F.first("size") >= n, F.avg(F.when(F.col("k") < n, r)) - 2 * bps / 10000), F.lit(0.0))

    rows = F.array(*(F.struct(F.lit(n).alias("n"), F.lit(float(stop)).alias("stop"), F.col(f"r{i}").alias("ret")) for i, (n, stop) in enumerate(legs)))
    by_period = met.groupBy("iteration", "as_of").agg(*(period(n, stop).alias(f"r{i}") for i, (n, stop) in enumerate(legs))).select("iteration", F.inline(rows))
    return by_period.groupBy("n", "stop", "iteration").agg(sharpe(F.lit(ppy), F.stddev_samp("ret"), F.avg("ret")).alias("sharpe"))


def percentile_of(trials: DataFrame, actual: DataFrame) -> DataFrame:
    """(strategy_id, n, sharpe, n_trials, mean_trial, percentile): the share of the trials of its own leg below each strategy.

    actual is (strategy_id, n, sharpe), with its stop where the trials were to match it.
    """
    keys = [k for k in ("n", "stop") if k in actual.columns]
    met = trials.withColumnRenamed("sharpe", "trial").join(actual.select("strategy_id", *keys, "sharpe"), keys)
    return met.groupBy("strategy_id", "n", "sharpe").agg(F.count(F.lit(1)).alias("n_trials"), F.avg("trial").alias("mean_trial"), (F.avg((F.col("trial") < F.col("sharpe")).cast("double")) * 100).alias("percentile"))


def bootstrap_samples(series: DataFrame, reps: int, mean_block: float = 3.0, seed: int = 42) -> DataFrame:
    """(rep, t, ret): stationary block samples of (t = 0.., ret). A block goes on with probability 1 - 1 / mean_block and wraps around."""
    n = series.agg(F.count("ret").alias("n")).first()["n"]
    grid = series.select("t").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1))))
    restart = (F.col("t") == 0) | (draw(seed, F.col("rep"), F.col("t"), "go") >= 1 - 1 / mean_block)
    start = F.floor(draw(seed, F.col("rep"), F.col("t"), "at") * n)
    w = Window.partitionBy("rep").orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    block = F.last(F.when(restart, F.struct(start.alias("s"), F.col("t").alias("t"))), ignorenulls=True).over(w)
    at = grid.withColumn("b", block).select("rep", "t", ((F.col("b.s") + F.col("t") - F.col("b.t")) % n).alias("i"))
    return at.join(series.select(F.col("t").alias("i"), "ret"), "i").select("rep", "t", "ret")


def bootstrap_interval(series: DataFrame, reps: int, mean_block: float = 3.0, ppy: int = 12, seed: int = 42) -> DataFrame:
    """(metric, p5, p50, p95) of the population-deviation Sharpe ratio, CAGR and drawdown over the samples."""
    e = equity(bootstrap_samples(series, reps, mean_block, seed), ("rep",))
    m = e.groupBy("rep").agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m"), F.stddev_pop("ret").alias("s"), (F.max_by("equity", "t") - 1).alias("total"), F.min("drawdown").alias("maxdd"))
    m = m.select(sharpe(F.lit(ppy), F.col("s"), F.col("m")).alias("sharpe"), cagr(F.col("total"), F.col("n") / ppy).alias("cagr"), "maxdd")
    long = m.unpivot([], ["sharpe", "cagr", "maxdd"], "metric", "v")
    return long.groupBy("metric").agg(*(F.percentile("v", F.lit(p)).alias(a) for p, a in ((0.05, "p5"), (0.5, "p50"), (0.95, "p95"))))


def expected_max_sharpe(n_trials, sigma):
    """Best per-period Sharpe ratio expected of n_trials without skill whose estimates deviate by sigma."""
    e = 2.718281828459045
    best = sigma * ((1 - EULER_GAMMA) * normal_ppf(1 - 1.0 / n_trials) + EULER_GAMMA * normal_ppf(1 - 1.0 / (n_trials * e)))
    return F.when((n_trials < 2) | (sigma <= 0), F.lit(0.0)).otherwise(best)


def deflated(stats: DataFrame, ppy: int = 12) -> DataFrame:
    """Metric rows with (n_trials, sigma, hurdle, dsr): trials are the rows themselves, sigma the deviation of their per-period ratios."""
    w = Window.partitionBy()  # one row per strategy
    per = per_period_sharpe(F.col("sharpe"), F.lit(ppy))
    s = stats.withColumns({"n_trials": F.count(F.lit(1)).over(w), "sigma": F.coalesce(F.stddev_samp(per).over(w), F.lit(0.0))})
    s = s.withColumn("hurdle", expected_max_sharpe(F.col("n_trials"), F.col("sigma")))
    return s.withColumn("dsr", psr(per, F.col("n"), F.col("skew"), F.col("kurt"), F.col("hurdle")))
