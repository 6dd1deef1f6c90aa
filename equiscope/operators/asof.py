"""Point-in-time joins: bitemporal as-of, membership intervals, forward as-of, filings by fiscal period."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.operators.calendar import dates_between


def by_ticker(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows by ticker in parts, else in as many as a shuffle has. A given number is not made smaller at run time: what follows holds many
    times the bytes that are shuffled, so that tasks made large by those bytes would take memory that grows with the input. Rows that
    are in the same parts already are not shuffled again."""
    return rows.repartition(parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "ticker")


def validity(facts: DataFrame, parts: int | None = None) -> DataFrame:
    """(ticker, field, value, valid_from, valid_to): what was known when.

    Known at a time is the value with the largest (report_date, observed_at) among those observed by then; a RANGE frame settles
    equal observation times together. One shuffle on ticker, whatever the number of dates asked for later; a pivot to (as_of, ticker) needs no other.
    """
    facts = by_ticker(facts, parts)
    w = Window.partitionBy("ticker", "field").orderBy("observed_at")
    known = F.max(F.struct("report_date", "observed_at", "value")).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    rows = facts.select("ticker", "field", "observed_at", known.alias("k")).dropDuplicates(["ticker", "field", "observed_at"])
    until = F.lead("observed_at").over(w)
    return rows.select("ticker", "field", F.col("k.value").alias("value"), F.col("k.report_date").alias("report_date"), F.col("observed_at").alias("valid_from"), until.alias("valid_to"))


def facts_as_of(facts: DataFrame, dates: list[date], parts: int | None = None) -> DataFrame:
    """(as_of, ticker, field, value, report_date) for every date; a fact counts from the midnight at or after it was observed."""
    start = F.col("valid_from")
    # visible at d when observed_at <= d 00:00
    low = F.when(start == F.date_trunc("day", start), F.to_date(start)).otherwise(F.date_add(F.to_date(start), 1))
    end = F.col("valid_to")
    high = F.when(end == F.date_trunc("day", end), F.to_date(end)).otherwise(F.date_add(F.to_date(end), 1))
    at = dates_between(dates, low, high, low_in=True, high_in=False)
    return validity(facts, parts).withColumn("as_of", F.explode(at)).select("as_of", "ticker", "field", "value", "report_date")


def facts_as_of_one(facts: DataFrame, tickers: DataFrame, fields: list[str], at: date) -> DataFrame:
    """(ticker, one column per field) at one date; every requested ticker stays. Filters reach the scan; one aggregation."""
    seen = facts.filter(F.col("field").isin(fields) & (F.col("observed_at") <= F.lit(at).cast("timestamp"))).join(tickers, "ticker", "left_semi")
    return tickers.join(pivoted(seen.groupBy("ticker", "field").agg(F.max_by("value", F.struct("report_date", "observed_at")).alias("value")), ["ticker"], fields), "ticker", "left")


def pivoted(long: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Long to wide over a fixed list of fields, so that the schema never depends on the data."""
    return long.groupBy(*keys).pivot("field", fields).agg(F.first("value", ignorenulls=True))


def active(d: Column, added: Column, removed: Column) -> Column:
    """Member at d; a removal on or before the addition is corrupt and counts as open."""
    return (added <= d) & (removed.isNull() | (removed <= added) | (removed > d))


def members_as_of(members: DataFrame, dates: list[date]) -> DataFrame:
    """(as_of, ticker) of every date's members. The stints are a small file that one task reads, and their dates many times that: they are dealt first."""
    until = F.when(F.col("removed_date") > F.col("added_date"), F.col("removed_date"))
    return by_ticker(members).withColumn("as_of", F.explode(dates_between(dates, F.col("added_date"), until, low_in=True, high_in=False))).select("as_of", "ticker").distinct()


def tradeable_as_of(bars: DataFrame, dates: list[date], lookback: int = 30) -> DataFrame:
    """(as_of, ticker) with a bar within lookback days before the date, both ends included."""
    at = dates_between(dates, F.col("date"), F.date_add("date", lookback), low_in=True)
    bars = bars.filter(F.col("date").between(F.lit(min(dates) - timedelta(days=lookback)), F.lit(max(dates))))
    return bars.select("ticker", F.explode(at).alias("as_of")).distinct()


def universe_as_of(members: DataFrame, bars: DataFrame, dates: list[date], lookback: int = 30) -> DataFrame:
    """(as_of, ticker): members that trade; the tradeable where a date has no members, the members where nothing trades."""
    return universe_of(members, tradeable_as_of(bars, dates, lookback), dates)


def universe_of(members: DataFrame, tradeable: DataFrame, dates: list[date]) -> DataFrame:
    """universe_as_of where the tradeable (as_of, ticker) are known."""
    m = members_as_of(members, dates).withColumn("m", F.lit(True))
    t = tradeable.withColumn("t", F.lit(True))
    w = Window.partitionBy("as_of")
    both = m.join(t, ["as_of", "ticker"], "full").withColumns({"any_m": F.count("m").over(w) > 0, "any_t": F.count("t").over(w) > 0})
    keep = (F.col("m").isNotNull() | ~F.col("any_m")) & (F.col("t").isNotNull() | ~F.col("any_t"))
    return both.filter(keep).select("as_of", "ticker")


def first_on_or_after(series: DataFrame, dates: list[date], keys: list[str], value: str = "close") -> DataFrame:
    """(keys, as_of, date, value): the first bar on or after each date; a bar serves the dates after the bar before it."""
    prev = F.lag("date").over(Window.partitionBy(*keys).orderBy("date") if keys else Window.orderBy("date"))
    before = F.coalesce(F.col("prev"), F.lit(date(1900, 1, 1)))
    return series.withColumn("prev", prev).withColumn("as_of", F.explode(dates_between(dates, before, F.col("date")))).select(*keys, "as_of", "date", value)


def latest_filing(rows: DataFrame) -> DataFrame:
    """One row per (ticker, calendardate): the filing with the latest datekey."""
    w = Window.partitionBy("ticker", "calendardate").orderBy(F.desc("datekey"))
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def filing_as_of(rows: DataFrame, period: str, names: list[str], other: DataFrame | None = None) -> DataFrame:
    """Each row with, under `_<name>`, the columns of the latest filing of its `period` that was public on its datekey.

    A self join on (ticker, period) only; a period that was not filed by then gives nulls, never another period.
    """
    other = rows if other is None else other
    f = other.select(F.col("ticker").alias("_t"), F.col("calendardate").alias("_p"), F.col("datekey").alias("_d"), F.struct(*(F.col(n).alias(n) for n in names)).alias("_s"))
    met = rows.select("ticker", "calendardate", "datekey", period).join(f, (F.col("ticker") == F.col("_t")) & (F.col(period) == F.col("_p")) & (F.col("_d") <= F.col("datekey")))
    best = met.groupBy("ticker", "calendardate", "datekey").agg(F.max_by("_s", "_d").alias("_s")).select("ticker", "calendardate", "datekey", *(F.col(f"_s.{n}").alias(f"_{n}") for n in names))
    return rows.join(best, ["ticker", "calendardate", "datekey"], "left")


def with_compared(filings: DataFrame, periods: dict[str, Column], names: list[str], parts: int | None = None) -> DataFrame:
    """Each filing with, under `<name>_<tag>`, the columns of the latest filing of each period in `periods` that was public on its datekey.

    A period is an expression over calendardate and prev_period, the period before among those the ticker has. A ticker's periods, a row
    each with its filings as an array, meet as a map in a window: one shuffle, no join, and no filing is repeated for what it is compared with.
    """
    rest = [c for c in filings.columns if c not in ("ticker", "calendardate")]
    by_period = by_ticker(filings, parts).groupBy("ticker", "calendardate").agg(F.collect_list(F.struct(*rest)).alias("own"))
    filed = F.transform("own", lambda x: F.struct(x["datekey"].alias("d"), *(x[n].alias(n) for n in names)))
    rows = by_period.withColumn("prev_period", F.lag("calendardate").over(Window.partitionBy("ticker").orderBy("calendardate")))
    # a null would be no key
    entry = F.when(F.col("calendardate").isNotNull(), F.struct("calendardate", filed.alias("filed")))
    rows = rows.withColumn("filed", F.map_from_entries(F.collect_list(entry).over(Window.partitionBy("ticker"))))
    rows = rows.select("ticker", "calendardate", "prev_period", *(F.element_at("filed", p).alias(f"filed_{t}") for t, p in periods.items()), F.inline("own"))
    public = {t: F.array_max(F.filter(f"filed_{t}", lambda x: x["d"] <= F.col("datekey"))) for t in periods}
    rows = rows.withColumns({f"filed_{t}": latest for t, latest in public.items()})
    return rows.select(*filings.columns, "prev_period", *(F.col(f"filed_{t}.{n}").alias(f"{n}_{t}") for t in periods for n in names))


def preceding_period(rows: DataFrame) -> DataFrame:
    """(ticker, calendardate, prev_period): the period before among those the ticker has."""
    periods = rows.select("ticker", "calendardate").distinct()
    return periods.withColumn("prev_period", F.lag("calendardate").over(Window.partitionBy("ticker").orderBy("calendardate")))
