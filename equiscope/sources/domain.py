"""Panel inputs from the star-schema tables: bars, membership, sectors, statements, facts, account records.

A ticker is a supplier. Every frame here is one narrow aggregation; prices and amounts are rounded once, at the source, so that
the order of a distributed sum never decides a rank.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscope.operators.asof import by_ticker

#: raw statement columns as weights of (revenue, discount, tax, quantity) totals of a supplier's quarter
STATEMENT = {
    "revenue": (1.0, 0.0, 0.0, 0.0), "cor": (0.55, 2.0, 0.0, 0.0), "sgna": (0.1, 0.0, 1.0, 0.0), "rnd": (0.02, 0.0, 0.0, 1.0),
    "netinc": (0.12, -2.5, 0.5, 0.0), "ebt": (0.12, -2.5, 1.5, 0.0), "taxexp": (0.0, 0.0, 1.0, 0.0), "ebit": (0.13, -2.5, 1.5, 0.0),
    "ebitda": (0.16, -2.5, 1.5, 0.0), "equity": (2.0, 10.0, 0.0, 0.0), "assets": (5.0, 0.0, 3.0, 0.0), "invcap": (3.0, 0.0, 0.0, 0.0),
    "marketcap": (20.0, -100.0, 0.0, 0.0), "debtusd": (0.8, 0.0, 1.0, 0.0), "cashnequsd": (0.3, 1.0, 0.0, 0.0), "fcf": (0.1, -1.8, 0.4, 0.0),
    "capex": (-0.04, -0.2, 0.0, 0.0), "ncfo": (0.14, -1.6, 0.4, 0.0), "sbcomp": (0.01, 0.0, 0.0, 0.0), "intangibles": (0.5, 1.0, 0.0, 0.0),
    "receivables": (0.25, 0.0, 0.0, 0.0), "inventory": (0.2, 0.0, 1.0, 0.0), "payables": (0.15, 1.0, 0.0, 0.0), "ev": (20.5, -101.0, 1.0, 0.0),
    "eps": (0.0012, -0.025, 0.005, 0.0), "opinc": (0.14, -2.0, 1.0, 0.0),
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticker(col: str) -> Column:
    return F.col(col).cast("string").alias("ticker")


def lines(spark: SparkSession, sf_dir: str, until: date | None = None) -> DataFrame:
    """Line items, with until those shipped by then: the bound reaches the scan."""
    line = read(spark, sf_dir, "lineitem")
    return line if until is None else line.filter(F.col("l_shipdate") <= F.lit(until))


#: line items for which a part is made
LINES_OF_PART = 1 << 18


def parts(spark: SparkSession, sf_dir: str) -> int:
    """How many parts line items are dealt to: as many as a shuffle has, and more where those would hold over LINES_OF_PART. The count is read off footers."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, "lineitem").count() // LINES_OF_PART))


def bars(spark: SparkSession, sf_dir: str, until: date | None = None) -> DataFrame:
    """(ticker, date, open, high, low, close, volume): daily bars at discounted retail prices, by ticker.

    Nearly every line item is a bar of its own, so an aggregation ahead of the shuffle would hold all rows of a task and give as many on.
    Line items are dealt by ticker first: their aggregation and the windows over a ticker's bars are one stage, whose tasks stay as they are as the input grows.
    """
    line = lines(spark, sf_dir, until).select("l_partkey", "l_suppkey", "l_shipdate", "l_discount", "l_quantity")
    part = read(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    price = F.col("p_retailprice") * (1 - F.col("l_discount"))
    priced = line.join(part, F.col("l_partkey") == F.col("p_partkey")).select(ticker("l_suppkey"), F.to_date("l_shipdate").alias("date"), price.alias("price"), "l_quantity")
    by_day = by_ticker(priced, parts(spark, sf_dir)).groupBy("ticker", "date")
    days = by_day.agg(F.avg("price").alias("mean"), F.max("price").alias("most"), F.min("price").alias("least"), F.sum("l_quantity").alias("volume"))
    # rounding goes through decimal text: once where all prices of a day are one
    days = days.withColumn("close", F.round("mean", 6))
    other = lambda c: F.when(F.col(c) == F.col("mean"), F.col("close")).otherwise(F.round(c, 6))
    return days.select("ticker", "date", F.col("close").alias("open"), other("most").alias("high"), other("least").alias("low"), "close", "volume")


def raw_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, date, low, close, volume): bars at unit prices, which jump from day to day."""
    line = read(spark, sf_dir, "lineitem")
    by_day = line.groupBy(ticker("l_suppkey"), F.to_date("l_shipdate").alias("date"))
    close = F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6)
    return by_day.agg(F.round(F.min(F.col("l_extendedprice") / F.col("l_quantity")), 6).alias("low"), close.alias("close"), F.sum("l_quantity").alias("volume"))


def membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ticker, index_name, added_date, removed_date, is_delisted); some stints are closed and some are corrupt."""
    s, n, r = (read(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    k = F.col("s_suppkey")
    added = F.add_months(F.lit("1995-01-01").cast("date"), (k % 24).cast("int"))
    removed = F.when(k % 11 == 0, F.date_sub(added, 30)).when(k % 7 == 0, F.add_months(added, 48))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(
        ticker("s_suppkey"), F.col("r_name").alias("index_name"), added.alias("added_date"), removed.alias("removed_date"), (k % 7 == 0).alias("is_delisted")
    )


def sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = (read(spark, sf_dir, t) for t in ("supplier", "nation"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(ticker("s_suppkey"), F.when(F.col("s_suppkey") % 13 != 0, F.col("n_name")).alias("sector"))


def statements(spark: SparkSession, sf_dir: str, until: date | None = None) -> DataFrame:
    """(ticker, calendardate, datekey, raw columns): each quarter's filing after 45 days, and an amendment without returns after 120.

    With until, all filings that are public by then, as they are without it; later ones may be there too, and incomplete.
    """
    line = lines(spark, sf_dir, until)
    price, kept = F.col("l_extendedprice"), F.col("l_returnflag") != "R"

    def total(v: Column, name: str) -> list[Column]:
        return [F.round(F.sum(v), 4).alias(name), F.round(F.sum(F.when(kept, v)), 4).alias(f"{name}_a")]

    sums = line.groupBy("l_suppkey", F.trunc("l_shipdate", "quarter").alias("quarter")).agg(
        *total(price, "rev"), *total(price * F.col("l_discount"), "disc"), *total(price * F.col("l_tax"), "tax"), *total(F.col("l_quantity"), "qty"), F.count(F.when(kept, 1)).alias("n_a")
    )
    # the ticker's text and the quarter's last day are made of the sums, and not of every line item
    sums = sums.select(ticker("l_suppkey"), F.last_day(F.add_months("quarter", 2)).alias("calendardate"), *sums.columns[2:])
    first = F.struct(F.lit(45).alias("lag"), "rev", "disc", "tax", "qty")
    amended = F.when(F.col("n_a") > 0, F.struct(F.lit(120).alias("lag"), *(F.col(f"{c}_a").alias(c) for c in ("rev", "disc", "tax", "qty"))))
    both = sums.select("ticker", "calendardate", F.explode(F.array_compact(F.array(first, amended))).alias("v")).select("ticker", "calendardate", F.date_add("calendardate", F.col("v.lag")).alias("datekey"), "v.*")
    made = [F.expr("round(" + " + ".join(f"{w!r}D * {c}" for w, c in zip(ws, ("rev", "disc", "tax", "qty"), strict=True)) + f", 4) as {name}") for name, ws in STATEMENT.items()]
    rows = both.select("ticker", "calendardate", "datekey", *made)
    ratio = F.try_divide(F.col("cashnequsd") + F.col("receivables"), F.col("payables") + 0.1 * F.col("revenue"))
    return rows.withColumn("currentratio", ratio).withColumn("grossmargin", F.try_divide(F.col("revenue") - F.col("cor"), F.col("revenue")))


def benchmark(panel: DataFrame) -> DataFrame:
    """(date, close): the mean close of all tickers."""
    return panel.groupBy("date").agg(F.round(F.avg("close"), 6).alias("close"))


def account_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(broker, ts, event_id, equity): a running balance per user over the event stream."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    equity = F.round(10000 + F.sum(F.round(F.col("value") * 20, 4)).over(w), 2)
    return read(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("broker"), F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", equity.alias("equity"))
