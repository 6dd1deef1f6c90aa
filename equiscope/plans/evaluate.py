"""Evaluation of return series: factor portfolios, walk-forward, guardrails, experiments, reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.operators.metrics import bundle, cagr, capm, regimes, sharpe
from equiscope.sources.tables import upsert


def _decile(value: Column, has: Column, n: Column) -> Column:
    k = F.row_number().over(Window.partitionBy("as_of").orderBy(has.desc(), value.desc_nulls_last(), "ticker"))
    return has & (k <= F.greatest(F.floor(n / 10), F.lit(1)))


def factor_returns(facts: DataFrame, features: DataFrame, returns: DataFrame, universe: DataFrame, least_names: int = 20) -> DataFrame:
    """(as_of, market, momentum, value, quality): means of the in-period returns of everything and of the top deciles.

    Momentum ranks all of the universe that has a past; value and quality rank what has facts and a return. A date below
    least_names gives zeros; one without facts gives the market for value and quality.
    """
    w = Window.partitionBy("as_of")
    mom = features.join(universe, ["as_of", "ticker"], "left_semi").withColumn("n", F.count(F.lit(1)).over(w))
    mom = mom.withColumn("m", _decile(F.col("trailing_return"), F.lit(True), F.col("n"))).select("as_of", "ticker", "m")
    r = returns.join(universe, ["as_of", "ticker"], "left_semi").select("as_of", "ticker", F.col("within_ret").alias("r"))
    r = r.join(mom, ["as_of", "ticker"], "left").join(facts.withColumn("has", F.lit(True)), ["as_of", "ticker"], "left").withColumn("has", F.coalesce("has", F.lit(False)))
    r = r.withColumn("nf", F.count_if("has").over(w))
    r = r.withColumns({"v": _decile(F.col("earnings_yield"), F.col("has"), F.col("nf")), "q": _decile(F.col("roe"), F.col("has"), F.col("nf"))})
    mean = lambda c: F.avg(F.when(F.col(c), F.col("r")))
    f = r.groupBy("as_of").agg(F.avg("r").alias("market"), F.coalesce(mean("m"), F.lit(0.0)).alias("momentum"), mean("v").alias("value"), mean("q").alias("quality"))
    names = universe.groupBy("as_of").agg(F.count(F.lit(1)).alias("names"))
    ok = F.col("names") >= least_names
    filled = {"market": F.col("market"), "momentum": F.col("momentum"), "value": F.coalesce("value", "market"), "quality": F.coalesce("quality", "market")}
    return f.join(names, "as_of").select("as_of", *(F.when(ok, c).otherwise(0.0).alias(k) for k, c in filled.items()))


def walk_forward_runs(runs: DataFrame, folds: int, ppy: int = 12) -> DataFrame:
    """(strategy_id, run, test_start, n, swaps, sharpe, total_return, max_drawdown, consistency) of folds that were run on their own.

    runs are period returns by (strategy_id, run); the consistency is the share of all `folds` with a positive ratio.
    """
    keys = ("strategy_id", "run")
    m = bundle(runs.select(*keys, "t", "ret"), ppy, keys)
    about = runs.groupBy(*keys).agg(F.min("as_of").alias("test_start"), F.sum("swaps").alias("swaps"))
    good = F.sum((F.col("sharpe") > 0).cast("int")).over(Window.partitionBy("strategy_id")) / folds
    return m.join(about, list(keys)).withColumn("consistency", good).select(*keys, "test_start", "n", "swaps", "sharpe", "total_return", "max_drawdown", "consistency")


def benchmark_summary(bench: DataFrame, ppy: int = 12) -> DataFrame:
    """Month-end statistics of one price series: population deviation, and a drawdown without the starting value."""
    m = bench.groupBy(F.trunc("date", "month").alias("m")).agg(F.max_by("close", "date").alias("c"))
    w = Window.orderBy("m")  # one row per month of one series
    m = m.withColumn("r", F.try_divide(F.col("c"), F.lag("c").over(w)) - 1)
    m = m.withColumn("peak", F.max(F.when(F.col("r").isNotNull(), F.col("c"))).over(w))
    total = F.try_divide(F.max_by("c", "m"), F.min_by("c", "m")) - 1
    s = m.agg(F.count("r").alias("n"), sharpe(F.lit(ppy), F.stddev_pop("r"), F.avg("r")).alias("sharpe"), F.min(F.when(F.col("r").isNotNull(), F.col("c") / F.col("peak") - 1)).alias("max_drawdown"), total.alias("total_return"))
    return s.select(F.lit("benchmark").alias("name"), "n", "sharpe", cagr(F.col("total_return"), F.col("n") / ppy).alias("cagr"), "max_drawdown", "total_return")


def guardrails(stats: DataFrame, least_periods: int = 30, least_sharpe: float = 0.5, worst_drawdown: float = -0.3) -> DataFrame:
    """The metric rows with a list of warnings."""
    w = F.array(F.when(F.col("n") < least_periods, "sample_size"), F.when(F.col("sharpe") < least_sharpe, "low_sharpe"), F.when(F.col("max_drawdown") < worst_drawdown, "deep_drawdown"))
    return stats.withColumn("warnings", F.filter(w, lambda x: x.isNotNull()))


def experiment(returns: DataFrame, holdout_from: date, ppy: int = 12, budget: int = 20, **limits) -> DataFrame:
    """(strategy_id, train_sharpe, warnings, best, holdout_sharpe): variations judged before holdout_from; only the best clean one
    is shown its holdout. More variations than the budget raise."""
    n = returns.select("strategy_id").distinct().count()
    if n > budget:
        raise ValueError(f"{n} variations: the budget is {budget}")
    before = F.col("as_of") < F.lit(holdout_from)
    train = guardrails(bundle(returns.filter(before).select("strategy_id", "t", "ret"), ppy), **limits).select("strategy_id", F.col("sharpe").alias("train_sharpe"), "cagr", "max_drawdown", "psr", "n", "warnings")
    held = bundle(returns.filter(~before).select("strategy_id", "t", "ret"), ppy).select("strategy_id", *(F.col(c).alias(f"h_{c}") for c in ("sharpe", "cagr", "max_drawdown")))
    clean = F.size("warnings") == 0
    rank = F.row_number().over(Window.orderBy(clean.desc(), F.desc("train_sharpe"), "strategy_id"))  # a budgeted handful of rows
    out = train.join(held, "strategy_id", "left").withColumn("best", (rank == 1) & clean)
    held_out = [F.when(F.col("best"), F.col(f"h_{c}")).alias(f"holdout_{c}") for c in ("sharpe", "cagr", "max_drawdown")]
    return out.select("strategy_id", "train_sharpe", "cagr", "max_drawdown", "psr", "n", F.concat_ws(",", "warnings").alias("warnings"), "best", *held_out)


EXPERIMENT_REPORT = "experiment_name string, hypothesis string, best_variation string, results array<struct<name:string,sharpe:double,cagr:double,max_drawdown:double,psr:double,sample_size:bigint,warnings:array<string>>>, holdout struct<sharpe:double,cagr:double,max_drawdown:double>"


def experiment_report(judged: DataFrame, name: str, hypothesis: str) -> DataFrame:
    """(experiment_name, document): one JSON document of the rows that `experiment` gives; holdout is null where no variation is clean."""
    r6 = lambda n, a: F.round(n, 6).alias(a)
    warned = F.filter(F.split("warnings", ","), lambda w: w != "")
    result = F.struct(F.col("strategy_id").alias("name"), r6("train_sharpe", "sharpe"), r6("cagr", "cagr"), r6("max_drawdown", "max_drawdown"), r6("psr", "psr"), F.col("n").alias("sample_size"), warned.alias("warnings"))
    held = F.struct(*(r6(f"holdout_{c}", c) for c in ("sharpe", "cagr", "max_drawdown")))
    g = judged.agg(F.array_sort(F.collect_list(result)).alias("results"), F.max(F.when(F.col("best"), F.col("strategy_id"))).alias("best_variation"), F.max(F.when(F.col("best"), held)).alias("holdout"))
    return g.select(F.lit(name).alias("experiment_name"), F.to_json(F.struct(F.lit(name).alias("experiment_name"), F.lit(hypothesis).alias("hypothesis"), "best_variation", "results", "holdout")).alias("document"))


def append_runs(log: DataFrame, runs: DataFrame) -> DataFrame:
    """The research log with new runs over it: a run that is logged again under its id replaces its row."""
    return upsert(log, runs, ["experiment_id"], ["completed_at"])


def budgets(log: DataFrame, most: int) -> DataFrame:
    """(experiment_name, n, holdout_used, left, may_use_holdout): what the log leaves each experiment of `most` runs and one use of its holdout."""
    g = log.groupBy("experiment_name").agg(F.count(F.lit(1)).alias("n"), F.count_if("holdout_used").alias("holdout_used"))
    return g.select("experiment_name", "n", "holdout_used", F.greatest(most - F.col("n"), F.lit(0)).alias("left"), (F.col("holdout_used") == 0).alias("may_use_holdout"))


REPORT = "metrics struct<n:bigint,total_return:double,sharpe:double,cagr:double,max_drawdown:double,psr:double>, regression struct<beta:double,alpha_annual:double,t_alpha:double,r2:double>, regimes array<struct<regime:string,n:bigint,avg_ret:double,sharpe:double>>, walk_forward struct<folds:bigint,consistency:double>, monte_carlo struct<trials:bigint,mean:double,percentile:double>, factors struct<r2:double,loadings:array<struct<term:string,coef:double>>>, correlations array<struct<a:string,b:string,corr:double,high:boolean>>, verdict map<string,int>"


def report(returns: DataFrame, bench: DataFrame, market: DataFrame, folds: DataFrame, placed: DataFrame, factors: DataFrame, correlations: DataFrame, ppy: int = 12, years: float | None = None) -> DataFrame:
    """(strategy_id, passed, document): all parts of an evaluation with 0/1 verdicts, as JSON of the schema REPORT.

    Metrics, regression on the benchmark, regimes, walk-forward, place among random portfolios of its size (placed, as resample.percentile_of gives it), loadings of each strategy
    (factors, as metrics.ols gives them) and the rank correlations of the signals, which are the same for all.
    """
    series = returns.select("strategy_id", "t", "ret")
    m, c = bundle(series, ppy, years=years), capm(series, bench, ppy)
    mc = placed.select("strategy_id", F.struct(F.col("n_trials").alias("trials"), F.round("mean_trial", 6).alias("mean"), F.round("percentile", 6).alias("percentile")).alias("monte_carlo"))
    fa = factors.groupBy("strategy_id").agg(F.struct(F.round(F.max("r2"), 6).alias("r2"), F.array_sort(F.collect_list(F.struct("term", F.round("coef", 6).alias("coef")))).alias("loadings")).alias("factors"))
    pairs = correlations.agg(F.array_sort(F.collect_list(F.struct("a", "b", F.round("corr", 6).alias("corr"), "high"))).alias("correlations"))
    g = regimes(series, market, ppy).groupBy("strategy_id").agg(F.array_sort(F.collect_list(F.struct("regime", "n", F.round("avg_ret", 6).alias("avg_ret"), F.round("sharpe", 4).alias("sharpe")))).alias("regimes"))
    f = folds.groupBy("strategy_id").agg(F.count(F.lit(1)).alias("folds"), F.max("consistency").alias("consistency"))
    d = m.join(c, "strategy_id").join(g, "strategy_id", "left").join(f, "strategy_id", "left").join(mc, "strategy_id", "left").join(fa, "strategy_id", "left")
    d = d.join(F.broadcast(pairs), F.lit(True))  # one row: the pairs of a handful of signals
    checks = {"significant": F.col("significant"), "sharpe": F.col("sharpe") > 0.5, "alpha": F.col("t_alpha") > 2, "consistent": F.col("consistency") >= 0.6, "beats_random": F.col("monte_carlo.percentile") >= 95}
    flags = [F.coalesce(v, F.lit(False)).cast("int").alias(k) for k, v in checks.items()]
    r6 = lambda n: F.round(n, 6).alias(n)
    doc = F.to_json(F.struct(F.struct("n", *map(r6, ("total_return", "sharpe", "cagr", "max_drawdown", "psr"))).alias("metrics"), F.struct(*map(r6, ("beta", "alpha_annual", "t_alpha", "r2"))).alias("regression"), "regimes", F.struct("folds", r6("consistency")).alias("walk_forward"), "monte_carlo", "factors", "correlations", F.struct(*flags).alias("verdict")))
    return d.select("strategy_id", sum(F.coalesce(v, F.lit(False)).cast("int") for v in checks.values()).alias("passed"), doc.alias("document"))
