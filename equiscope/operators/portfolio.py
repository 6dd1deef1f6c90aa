"""Ranking, weights, returns and costs of portfolios; every date and strategy at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_score() -> list[Column]:
    return [F.col("composite_score").desc(), F.col("ticker").asc()]


def top_n(df: DataFrame, n: int, cap: int = 0, keys: tuple[str, ...] = ("as_of",)) -> DataFrame:
    """The n best per date with their rank, ties by ticker; with a cap, at most that many of a sector (null is a sector)."""
    if cap:
        sector = F.coalesce("sector", F.lit("__unknown__"))
        df = df.withColumn("_s", F.row_number().over(Window.partitionBy(*keys, sector).orderBy(*by_score()))).filter(F.col("_s") <= cap).drop("_s")
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by_score()))).filter(F.col("rank") <= n)


def equal_weight(keys: tuple[str, ...] = ("as_of",)) -> Column:
    return F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys))


def inverse_vol_weight(vol: str = "realized_vol_20d", keys: tuple[str, ...] = ("as_of",)) -> Column:
    """1 / vol over its sum; a missing or non-positive vol takes the median of the usable 1 / vol; with none usable, equal."""
    w = Window.partitionBy(*keys)
    inverse = F.when(F.col(vol) > 0, 1 / F.col(vol))
    filled = F.coalesce(inverse, F.median(inverse).over(w))
    return F.coalesce(F.try_divide(filled, F.sum(filled).over(w)), equal_weight(keys))


def turnover(picks: DataFrame, dates: DataFrame, bps: float, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, as_of, n, symdiff, traded, swaps, drift, cost) from one period's picks to the next.

    traded is the symmetric difference over n, 1 at first; drift adds the changes of held names' weights beyond a twentieth of the
    new weight. Each pick meets its neighbours by an equi join on (ticker, date); nothing is gathered.
    """
    cal = dates.select("as_of", "next_as_of")
    now = picks.select(*keys, "as_of", "ticker", F.col("target_weight").alias("w"))
    before = now.join(F.broadcast(cal), "as_of").filter("next_as_of is not null").select(*keys, F.col("next_as_of").alias("as_of"), "ticker", F.col("w").alias("pw"))
    both = now.join(before, [*keys, "as_of", "ticker"], "full")
    change = F.abs(F.col("w") - F.col("pw"))
    out = both.groupBy(*keys, "as_of").agg(
        F.count("w").alias("n"), F.count("pw").alias("n_before"), F.count_if(F.col("w").isNull() | F.col("pw").isNull()).alias("symdiff"),
        F.coalesce(F.sum(F.when(change > 0.05 * F.col("w"), change)), F.lit(0.0)).alias("drift"),
    ).filter("n > 0")
    first = F.col("n_before") == 0
    traded = F.when(first, F.lit(1.0)).otherwise(F.col("symdiff") / F.col("n"))
    out = out.withColumns({"traded": traded, "swaps": F.when(first, F.lit(0)).otherwise(F.floor(F.col("symdiff") / 2)).cast("long")})
    return out.select(*keys, "as_of", "n", "n_before", "symdiff", "traded", "swaps", "drift", ((F.col("traded") + F.col("drift")) * bps / 10000).alias("cost"))


def portfolio_returns(picks: DataFrame, returns: DataFrame, keys: tuple[str, ...] = (), stop: float = 0.0) -> DataFrame:
    """(keys, as_of, n, priced, stopped, gross): weighted return over all picks; one without prices gives 0 and keeps its weight.

    With a stop, a pick whose low fell below (1 - stop) of its start returns -stop and is counted.
    """
    ret = F.coalesce("ret", F.lit(0.0))
    hit = F.coalesce(F.col("min_low") < F.col("start_price") * (1 - stop), F.lit(False)) if stop else F.lit(False)
    met = picks.join(returns.select("as_of", "ticker", "ret", "min_low", "start_price"), ["as_of", "ticker"], "left")
    return met.groupBy(*keys, "as_of").agg(
        F.count(F.lit(1)).alias("n"), F.count("ret").alias("priced"), F.count_if(hit).alias("stopped"),
        F.sum(F.col("target_weight") * F.when(hit, F.lit(-stop)).otherwise(ret)).alias("gross"),
    )
