"""Scalar expressions: guarded ratios, normal distribution, hash draws, lenient parsing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Coefficients of the rational approximations of the inverse normal distribution (Acklam) and of the normal
# distribution (Hart).
PPF_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
PPF_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
PPF_EDGE = 0.02425
CDF_N = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
CDF_D = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
EULER_GAMMA = 0.5772156649015329


def poly(coefficients: tuple[float, ...], x: Column) -> Column:
    """Highest power first."""
    return reduce(lambda acc, c: acc * x + F.lit(c), coefficients[1:], F.lit(coefficients[0]))


def ratio(n: Column, d: Column) -> Column:
    """n / d; null if either is null or d is 0."""
    return F.try_divide(n, d)


def growth(now: Column, base: Column) -> Column:
    """now / base - 1, only from a positive base."""
    return F.when(base > 0, now / base - 1)


def clip(x: Column, low: float | Column, high: float | Column) -> Column:
    """Null stays null (greatest and least would turn it into a bound)."""
    low, high = (v if isinstance(v, Column) else F.lit(float(v)) for v in (low, high))
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


def not_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def periods_per_year(frequency: Column) -> Column:
    return F.when(frequency == "weekly", 52).when(frequency == "quarterly", 4).otherwise(12)


def per_period_sharpe(annual: Column, ppy: Column) -> Column:
    return annual / F.sqrt(ppy)


def normal_cdf(x: Column) -> Column:
    """P(Z <= x) to about 1e-14 for |x| < 7.07, by a rational approximation, so that it stays in generated code."""
    a = F.abs(x)
    e = F.exp(-a * a / 2)
    low = e * poly(CDF_N, a) / poly(CDF_D, a)
    far = e / (a + 1 / (a + 2 / (a + 3 / (a + 4 / (a + F.lit(0.65)))))) / 2.506628274631
    tail = F.when(a > 37, F.lit(0.0)).when(a < 7.07106781186547, low).otherwise(far)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def normal_ppf(p: Column) -> Column:
    """Inverse of the normal distribution, error below 1.2e-9; infinite at 0 and 1."""
    inner = F.greatest(F.least(p, F.lit(1 - 1e-300)), F.lit(1e-300))
    q_low, q_high = F.sqrt(-2 * F.log(inner)), F.sqrt(-2 * F.log(F.greatest(1 - inner, F.lit(1e-300))))
    q = inner - 0.5
    return (
        F.when(p <= 0, F.lit(-math.inf))
        .when(p >= 1, F.lit(math.inf))
        .when(p < PPF_EDGE, poly(PPF_C, q_low) / poly(PPF_D, q_low))
        .when(p > 1 - PPF_EDGE, -poly(PPF_C, q_high) / poly(PPF_D, q_high))
        .otherwise(poly(PPF_A, q * q) * q / poly(PPF_B, q * q))
    )


def draw(*key: Column | str | int) -> Column:
    """A uniform number in [0, 1) that depends on the key alone and is the same in any engine: 52 bits of an md5."""
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(p.cast("string") for p in parts))), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def date_prefix(text: Column) -> Column:
    """A date from the first ten characters; null if they are none."""
    return F.try_to_date(F.substring(text, 1, 10)) if hasattr(F, "try_to_date") else F.to_date(F.try_to_timestamp(F.substring(text, 1, 10)))


def file_time(name: Column, fallback: Column) -> Column:
    """The YYYYMMDD_HHMMSS in a file name; else the fallback date at 12:00."""
    stamp = F.regexp_extract(name, r"(\d{8}_\d{6})", 1)
    return F.coalesce(F.try_to_timestamp(F.nullif(stamp, F.lit("")), F.lit("yyyyMMdd_HHmmss")), F.try_to_timestamp(F.concat(fallback.cast("string"), F.lit(" 12:00:00"))))


def first_positive(*texts: Column) -> Column:
    """The first of some texts that is a number above 0."""
    numbers = [t.try_cast("double") for t in texts]
    return F.coalesce(*(F.when(n > 0, n) for n in numbers))


def bps(x: Column) -> Column:
    return x * 10000


def signed(side: Column, x: Column) -> Column:
    return F.when(side == "buy", x).otherwise(-x)
