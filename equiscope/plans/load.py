"""A history load: what an index's members of a window need, in stored tables, and the report on it."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscope.operators.facts import staleness
from equiscope.sources.tables import append_absent, members_overlapping, prices, with_dates
from equiscope.sources.versioned import Versioned

TABLES = ("facts", "prices", "benchmark", "sectors")


def stored(log: Versioned, version: int, part: str) -> DataFrame | None:
    """One part of a version as it was written; None where the version has none of it.

    Folders of loads that were cut off lie beside those of the version, so a reader asks for a version and not for the whole path.
    """
    names = [n for n in log.folders(version) if n.startswith(f"{part}/")]
    return log.spark.read.option("basePath", f"{log.path}/{part}").parquet(*(f"{log.path}/{n}" for n in names)).drop("load") if names else None


def _written(log: Versioned, part: str, rows: DataFrame) -> list[str]:
    name = f"{part}/load={uuid.uuid4().hex}"
    rows.write.parquet(f"{log.path}/{name}")
    return [name]


def _added(log: Versioned, version: int, part: str, rows: DataFrame, keys: list[str]) -> list[str]:
    """Write rows whose keys the version does not hold yet; the first of equal keys in a load, and the stored one, stay. The new folder, if it has rows."""
    have = stored(log, version, part)
    new = append_absent(rows.limit(0) if have is None else have, rows, keys, sorted(set(rows.columns) - set(keys)))
    names = _written(log, part, new)
    empty = have is not None and log.spark.read.parquet(f"{log.path}/{names[0]}").isEmpty()
    return [] if empty else names


def history(spark: SparkSession, path: str, members: DataFrame, facts: DataFrame, bars: DataFrame, benchmark: DataFrame, sectors: DataFrame, start: date) -> int:
    """Store membership, and facts, prices and sectors of every name whose stint overlaps the window, departed ones too; the version made.

    All parts become visible in one commit: readers, and a run after one that was cut off, see whole loads only. Running it again
    adds what is new: nothing that is stored is overwritten, but for the membership of the indexes, which is replaced. If another
    load commits first, this one looks again at what is stored, so that of two loads none stores a key twice.
    """
    wanted = members_overlapping(members, start)
    parts = {
        "facts": (facts.join(wanted, "ticker", "left_semi"), ["ticker", "field", "report_date", "observed_at"]),
        "prices": (prices(bars, wanted, start, date.max), ["ticker", "date"]),
        "benchmark": (benchmark.filter(F.col("date") >= F.lit(start)).withColumn("ticker", F.lit("benchmark")), ["ticker", "date"]),
        "sectors": (sectors.join(wanted, "ticker", "left_semi"), ["ticker"]),
    }
    log, named = Versioned(spark, path, members.schema), with_dates(members)
    while True:
        at = log.version()
        others = stored(log, at, "membership")
        kept = None if others is None else others.join(named.select("index_name").distinct(), "index_name", "left_anti")
        new = _written(log, "membership", named if kept is None else named.unionByName(kept))
        for part, (rows, keys) in parts.items():
            new += _added(log, at, part, rows, keys)
        if log.commit(at, [n for n in log.folders(at) if not n.startswith("membership/")] + new):
            return at + 1


def swept(spark: SparkSession, path: str) -> list[str]:
    """Delete folders that no version names, those of loads that were cut off; only while nobody loads. The names deleted."""
    log, gone = Versioned(spark, path, "ticker string"), []
    used = {n for v in range(log.version() + 1) for n in log.folders(v)}
    Path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for part in ("membership", *TABLES):
        at = Path(f"{path}/{part}")
        for name in [f"{part}/{s.getPath().getName()}" for s in fs.listStatus(at)] if fs.exists(at) else []:
            if "/load=" in name and name not in used:
                fs.delete(Path(f"{path}/{name}"), True)
                gone.append(name)
    return sorted(gone)


def report(spark: SparkSession, path: str, today: date, version: int | None = None) -> DataFrame:
    """(part, n, tickers) of every part of a version, the last by default, and of overdue names: the quarters they are behind and how many they are."""
    log = Versioned(spark, path, "ticker string")
    at = log.version() if version is None else version
    if at < 0:
        raise ValueError(f"nothing is loaded at {path}")
    parts = {"members": stored(log, at, "membership"), **{t: stored(log, at, t) for t in TABLES}}
    out = None
    for name, df in parts.items():
        n = df.groupBy("ticker").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("tickers")).select(F.lit(name).alias("part"), "n", "tickers")
        out = n if out is None else out.unionByName(n)
    late = staleness(parts["facts"].select("ticker", "report_date"), today)
    return out.unionByName(late.agg(F.coalesce(F.sum("quarters_behind"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("tickers")).select(F.lit("overdue").alias("part"), "n", "tickers"))
