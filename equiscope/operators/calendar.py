"""Rebalance calendars as driver-side date lists, joined to data as array literals."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def add_months(d: date, n: int) -> date:
    y, m = divmod(d.year * 12 + d.month - 1 + n, 12)
    return date(y, m + 1, 1)


def rebalance_dates(start: date, end: date, frequency: str = "monthly") -> list[date]:
    """Weekly from the first Monday on or after start; monthly and quarterly from the first of start's month; end included."""
    if frequency == "weekly":
        d, step = start + timedelta(days=-start.weekday() % 7), None
    else:
        d, step = start.replace(day=1), {"monthly": 1, "quarterly": 3}[frequency]
    out = []
    while d <= end:
        out.append(d)
        d = d + timedelta(days=7) if step is None else add_months(d, step)
    return out


def calendar(spark: SparkSession, start: date, end: date, frequency: str = "monthly") -> DataFrame:
    """(as_of, next_as_of, period): one row per rebalance date; the last has no next."""
    if frequency == "weekly":
        first = start + timedelta(days=-start.weekday() % 7)
        step = "interval 7 days"
    else:
        first, step = start.replace(day=1), {"monthly": "interval 1 month", "quarterly": "interval 3 months"}[frequency]
    days = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{end}', {step})")).alias("as_of"))
    w = Window.orderBy("as_of")  # a calendar is a few thousand rows at most
    return days.withColumn("next_as_of", F.lead("as_of").over(w)).withColumn("period", F.row_number().over(w) - 1)


def literal(dates: list[date]) -> Column:
    return F.array(*(F.lit(d) for d in dates))


def before(dates: list[date], day: Column, itself: bool) -> Column:
    """How many dates of the sorted list lie before a day, or on it too: read off a table with an entry for each day that the list spans."""
    days = [(d - dates[0]).days for d in dates]
    counts, n = [], 0
    for i in range(days[-1] + 1):
        upto = n + (days[n] == i)
        counts.append(upto if itself else n)
        n = upto
    at = F.datediff(day, F.lit(dates[0]))
    return F.when(at < 0, F.lit(0)).when(at > days[-1], F.lit(len(dates))).otherwise(F.get(F.expr(f"array({', '.join(map(str, counts))})"), at))


def _some(items: Column, first: Column, n: Column) -> Column:
    return F.when(n > 0, F.slice(items, first + 1, n)).otherwise(F.slice(items, 1, 0))


def dates_between(dates: list[date], low: Column, high: Column, low_in: bool = False, high_in: bool = True) -> Column:
    """The calendar's dates in an interval, as an array to explode: a range join without join or shuffle. A null high is open."""
    first = before(dates, low, not low_in)
    last = F.when(high.isNull(), F.lit(len(dates))).otherwise(before(dates, high, high_in))
    return _some(literal(dates), first, last - first)


def period_of(dates: list[date], day: Column) -> Column:
    """The period (a, b) of consecutive dates that holds a day, a <= day < b, as an array of one or none."""
    pairs = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in zip(dates, dates[1:], strict=False)))
    n = before(dates, day, True)
    return _some(pairs, n - 1, F.when((n > 0) & (n < len(dates)), F.lit(1)).otherwise(F.lit(0)))


def folds(start: date, end: date, train: int, test: int, step: int) -> list[tuple[date, date, date]]:
    """(train start, test start, test end) of each walk-forward fold whose test ends by end."""
    out, d = [], start
    while add_months(d, train + test) <= end:
        out.append((d, add_months(d, train), add_months(d, train + test)))
        d = add_months(d, step)
    return out
