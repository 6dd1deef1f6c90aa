"""Stored tables: appends, upserts, replacement and scans, as frames over Parquet."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscope.functions.scalar import date_prefix
from equiscope.sources.schemas import RENAMED


def prices(bars: DataFrame, tickers: DataFrame, start: date, end: date) -> DataFrame:
    """Bars of the tickers, both dates included; the interval reaches the scan."""
    return bars.filter(F.col("date").between(start, end)).join(tickers, "ticker", "left_semi")


def cached_span(bars: DataFrame) -> DataFrame:
    return bars.groupBy("ticker").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count(F.lit(1)).alias("n"))


def append_absent(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of batch to append: one per key, the first in order, and none whose key is stored (first write wins)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r").join(target.select(*keys), keys, "left_anti")


def upsert(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """target with batch over it: of equal keys the last in batch order wins. Incremental rows only are sorted; the rest pass an anti join."""
    w = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    last = batch.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
    return target.join(last.select(*keys), keys, "left_anti").unionByName(last.select(*target.columns))


def parsed_observations(batch: DataFrame) -> DataFrame:
    """Text observation times to midnight timestamps by their first ten characters."""
    return batch.withColumn("observed_at", date_prefix(F.col("observed_at")).cast("timestamp"))


def changed(observations: DataFrame) -> DataFrame:
    """Observations whose value differs, null-safe, from the one before for their (ticker, field, report_date)."""
    w = Window.partitionBy("ticker", "field", "report_date").orderBy("observed_at")
    n, prev = F.row_number().over(w), F.lag("value").over(w)
    return observations.withColumns({"_n": n, "_p": prev}).filter((F.col("_n") == 1) | ~F.col("value").eqNullSafe(F.col("_p"))).drop("_n", "_p")


def without(bars: DataFrame, tickers: DataFrame) -> DataFrame:
    return bars.join(tickers, "ticker", "left_anti")


def sync_members(stored: DataFrame, current: DataFrame, today: date) -> DataFrame:
    """Stored stints with open ones closed for names that left, and new ones opened for names that came."""
    here = current.select("ticker", "index_name").distinct().withColumn("here", F.lit(True))
    is_open = F.col("removed_date").isNull()
    old = stored.join(here, ["ticker", "index_name"], "left").withColumn("removed_date", F.when(is_open & F.col("here").isNull(), F.lit(today)).otherwise(F.col("removed_date"))).drop("here")
    new = here.drop("here").join(stored.filter(is_open).select("ticker", "index_name"), ["ticker", "index_name"], "left_anti")
    return old.unionByName(new.select("ticker", "index_name", F.lit(today).alias("added_date"), F.lit(None).cast("date").alias("removed_date"), F.lit(False).alias("is_delisted")).select(*old.columns))


def with_dates(members: DataFrame) -> DataFrame:
    """Membership with dates; those in text that are none become null."""
    return members.withColumns({c: date_prefix(F.col(c).cast("string")) for c in ("added_date", "removed_date")})


def replace_index(spark: SparkSession, path: str, rows: DataFrame) -> None:
    """Replace the membership of the indexes in rows, atomically per index; dates in text that are none become null."""
    with_dates(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("index_name").parquet(path)


def vendor_fields(records: DataFrame, passed: list[str]) -> DataFrame:
    """Vendor columns under the canonical names as doubles; a missing one is a typed null."""
    have = set(records.columns)
    pick = lambda src, dst: (F.col(src).try_cast("double") if src in have else F.lit(None).cast("double")).alias(dst)
    keep = [c for c in ("ticker", "sector", "name") if c in have]
    return records.select(*keep, *(pick(s, d) for s, d in RENAMED.items()), *(pick(p, p) for p in passed))


def vendor_bars(spark: SparkSession, path: str) -> DataFrame:
    """Vendor price JSON, an explicit schema."""
    raw = spark.read.schema("symbol string, date string, open double, high double, low double, close double, volume double").json(path)
    return raw.select(F.col("symbol").alias("ticker"), F.try_to_timestamp("date").cast("date").alias("date"), "open", "high", "low", "close", "volume")


def routed(stocks: DataFrame, funds: DataFrame, fund_symbols: DataFrame) -> DataFrame:
    """Bars of fund symbols from the fund source and of all others from the stock source."""
    return stocks.join(fund_symbols, "ticker", "left_anti").unionByName(funds.join(fund_symbols, "ticker", "left_semi").select(*stocks.columns))


def historic_members(members: DataFrame, fallback: DataFrame) -> DataFrame:
    """Distinct tickers ever, without symbols that hold a slash; the fallback list where there are none."""
    own = members.filter(~F.col("ticker").contains("/")).select("ticker").distinct()
    any_ = own.limit(1).select(F.lit(True).alias("x"))
    return own.unionByName(fallback.select("ticker").distinct().join(F.broadcast(any_), F.lit(True), "left_anti"))


def members_overlapping(members: DataFrame, start: date) -> DataFrame:
    return members.filter(F.col("removed_date").isNull() | (F.col("removed_date") >= F.lit(start))).select("ticker").distinct()
