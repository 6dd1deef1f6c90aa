"""Risk and return statistics of return series (keys, t, ret), as aggregations over windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import normal_cdf

KEYS = ("strategy_id",)


def equity(series: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The series with its compounded equity, the peak so far (at least the starting 1) and the drawdown."""
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("equity", F.product(1 + F.col("ret")).over(w))
    s = s.withColumn("peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    return s.withColumn("drawdown", F.col("equity") / F.col("peak") - 1)


def sharpe(ppy: Column, std: Column, mean: Column) -> Column:
    """Annualized; 0 where the deviation is null or 0."""
    return F.when(std.isNull() | (std == 0), F.lit(0.0)).otherwise(mean / std * F.sqrt(ppy))


def cagr(total: Column, years: Column) -> Column:
    return F.when((years <= 0) | (total <= -1), F.lit(0.0)).otherwise(F.pow(1 + total, 1 / years) - 1)


def psr(per_period: Column, n: Column, skew: Column, kurt: Column, hurdle: Column | float = 0.0) -> Column:
    """Probability that the true per-period Sharpe ratio exceeds the hurdle; kurt is full (normal: 3)."""
    hurdle = hurdle if isinstance(hurdle, Column) else F.lit(float(hurdle))
    se = F.sqrt(F.greatest(1 - skew * per_period + (kurt - 1) / 4 * per_period * per_period, F.lit(0.0)) / F.greatest(n - 1, F.lit(1)))
    return F.when(n < 2, F.lit(0.0)).when(se == 0, F.lit(0.5)).otherwise(normal_cdf(F.try_divide(per_period - hurdle, se)))


def bundle(series: DataFrame, ppy: int = 12, keys: tuple[str, ...] = KEYS, years: float | None = None) -> DataFrame:
    """One row per series: n, total_return, sharpe, cagr, max_drawdown, calmar, skew, kurt, psr, significant (n >= 30).

    years is the span that the growth rate is for; n / ppy where it is not given.
    """
    s = equity(series, keys).groupBy(*keys).agg(
        F.count("ret").alias("n"), F.avg("ret").alias("mean_ret"), F.stddev_samp("ret").alias("std_ret"), F.max_by("equity", "t").alias("final"), F.min("drawdown").alias("max_drawdown"),
        F.coalesce(F.skewness("ret"), F.lit(0.0)).alias("skew"), (F.coalesce(F.kurtosis("ret"), F.lit(0.0)) + 3).alias("kurt"),
    )
    s = s.withColumn("total_return", F.col("final") - 1).withColumn("sharpe", sharpe(F.lit(ppy), F.col("std_ret"), F.col("mean_ret")))
    s = s.withColumn("cagr", cagr(F.col("total_return"), F.col("n") / ppy if years is None else F.lit(years)))
    s = s.withColumn("calmar", F.coalesce(F.try_divide(F.col("cagr"), F.abs("max_drawdown")), F.lit(0.0)))
    s = s.withColumn("psr", psr(F.col("sharpe") / F.sqrt(F.lit(ppy)), F.col("n"), F.col("skew"), F.col("kurt")))
    return s.select(*keys, "n", "total_return", "sharpe", "cagr", "max_drawdown", "calmar", "skew", "kurt", "psr", (F.col("n") >= 30).alias("significant"))


def capm(series: DataFrame, market: DataFrame, ppy: int = 12, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, k, beta, alpha, alpha_annual, t_alpha, r2) against market (t, mkt), joined by period; null below 3 periods or a flat market."""
    m = series.join(market.select("t", "mkt"), "t").groupBy(*keys).agg(
        F.count(F.lit(1)).alias("k"), F.regr_sxx("ret", "mkt").alias("sxx"), F.regr_sxy("ret", "mkt").alias("sxy"), F.regr_syy("ret", "mkt").alias("syy"), F.avg("ret").alias("my"), F.avg("mkt").alias("mx")
    )
    ok = (F.col("k") >= 3) & (F.col("sxx") / F.col("k") > 1e-12)
    m = m.withColumn("beta", F.when(ok, F.try_divide(F.col("sxy"), F.col("sxx")))).withColumn("alpha", F.col("my") - F.col("beta") * F.col("mx"))
    m = m.withColumn("sse", F.greatest(F.col("syy") - F.col("beta") * F.col("sxy"), F.lit(0.0)))
    se = F.sqrt(F.try_divide(F.col("sse"), F.col("k") - 2) * (1 / F.col("k") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))))
    r2 = F.greatest(1 - F.try_divide(F.col("sse"), F.col("syy")), F.lit(0.0))
    return m.select(*keys, "k", "beta", "alpha", (F.col("alpha") * ppy).alias("alpha_annual"), F.try_divide(F.col("alpha"), se).alias("t_alpha"), F.when(ok, F.coalesce(r2, F.lit(0.0))).alias("r2"))


def average_rank(value: Column, keys: list[str]) -> Column:
    """Rank with ties at their mean."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2


def rank_correlations(long: DataFrame, least_names: int = 20) -> DataFrame:
    """(as_of, ticker, signal, value) -> (a, b, n_dates, corr, high): mean over dates of the pairwise rank correlations.

    Constants give no correlation and are skipped; dates with fewer than least_names names too. The pair join is on
    (as_of, ticker), so it grows with rows times the number of signals.
    """
    r = long.withColumn("r", average_rank(F.col("value"), ["as_of", "signal"])).select("as_of", "ticker", "signal", "r")
    b = r.select("as_of", "ticker", F.col("signal").alias("b"), F.col("r").alias("rb"))
    pairs = r.withColumnRenamed("signal", "a").join(b, ["as_of", "ticker"]).filter("a < b")
    corr = F.try_divide(F.covar_samp("r", "rb"), F.stddev_samp("r") * F.stddev_samp("rb"))
    by_date = pairs.groupBy("as_of", "a", "b").agg(corr.alias("c"), F.count(F.lit(1)).alias("n")).filter((F.col("n") >= least_names) & F.col("c").isNotNull())
    return by_date.groupBy("a", "b").agg(F.count("c").alias("n_dates"), F.avg("c").alias("corr")).withColumn("high", F.abs("corr") > 0.7)


def regimes(series: DataFrame, market: DataFrame, ppy: int = 12, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, regime, n, avg_ret, sharpe) with Bull above 2 %, Bear below -2 %, else Flat by the market's period return."""
    regime = F.when(F.col("mkt") > 0.02, "Bull").when(F.col("mkt") < -0.02, "Bear").otherwise("Flat")
    g = series.join(market.select("t", "mkt"), "t").withColumn("regime", regime).groupBy(*keys, "regime")
    return g.agg(F.count("ret").alias("n"), F.avg("ret").alias("avg_ret"), sharpe(F.lit(ppy), F.stddev_samp("ret"), F.avg("ret")).alias("sharpe"))


def cross_moments(df: DataFrame, y: str, xs: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """n, sums and cross products of the regressors (with a constant) and y in one pass: what a least-squares fit needs."""
    cols = ["_one", *xs]
    df = df.withColumn("_one", F.lit(1.0))
    parts = [F.sum(F.col(a) * F.col(b)).alias(f"m_{i}_{j}") for i, a in enumerate(cols) for j, b in enumerate(cols) if j >= i]
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *parts, *(F.sum(F.col(a) * F.col(y)).alias(f"v_{i}") for i, a in enumerate(cols)), F.sum(F.col(y) * F.col(y)).alias("yy"), F.sum(y).alias("ys"))


def ols(df: DataFrame, y: str, xs: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """(keys, term, coef, r2): coefficients of y on xs with a constant; zeros below k + 2 or 5 rows, or where xs are collinear.

    Spark sums the moments; the solve is of constant size per key.
    """
    import numpy as np
    import pandas as pd

    k = len(xs) + 1
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    spec = ", ".join(f"`{c}` {kinds[c]}" for c in keys) + ", term string, coef double, r2 double"

    def solve(batches):
        for p in batches:
            out = []
            for row in p.to_dict("records"):
                a = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        a[i, j] = a[j, i] = row[f"m_{i}_{j}"]
                v = np.array([row[f"v_{i}"] for i in range(k)])
                n, coef, r2 = row["n"], np.zeros(k), 0.0
                if n >= max(k + 1, 5) and np.linalg.matrix_rank(a, tol=1e-12 * max(1.0, np.abs(a).max())) == k:
                    coef = np.linalg.solve(a, v)
                    sst = row["yy"] - row["ys"] ** 2 / n
                    r2 = max(0.0, 1 - (row["yy"] - coef @ v) / sst) if sst > 0 else 0.0
                out += [{**{c: row[c] for c in keys}, "term": t, "coef": float(c_), "r2": float(r2)} for t, c_ in zip(["const", *xs], coef, strict=True)]
            yield pd.DataFrame(out, columns=[*keys, "term", "coef", "r2"])

    return cross_moments(df, y, xs, keys).mapInPandas(solve, spec)
