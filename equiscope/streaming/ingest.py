"""Streaming forms of the table maintenance: deduplicated bars, fact upserts and daily bars from ticks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from equiscope.sources.versioned import Versioned


def bar_stream(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Bars with event time `ts`, the first of each (ticker, date) within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["ticker", "date"])


def daily_bars(ticks: DataFrame, delay: str = "2 hours") -> DataFrame:
    """Tumbling daily bars of ticks (ticker, ts, seq, price, size); ticks later than the watermark are dropped."""
    day = F.window("ts", "1 day")
    at = F.struct("ts", "seq")
    bars = ticks.withWatermark("ts", delay).groupBy(day.alias("w"), "ticker").agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("size").alias("volume")
    )
    return bars.select("ticker", F.to_date("w.start").alias("date"), "open", "high", "low", "close", "volume")


def current_facts(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order)))
    return rows.withColumn("_r", last).filter("_r = 1").drop("_r")


def upsert_facts(path: str, keys: list[str], order: list[str]):
    """A foreachBatch function that adds each batch's last rows to the table under path; current_facts of it is the upserted table.

    A batch costs its own rows and not the table's. It goes whole under its own number, so one that is run again after a failure
    replaces itself. `compacted` bounds what a reader has to sort out.
    """

    def run(batch: DataFrame, number: int) -> None:
        current_facts(batch, keys, order).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run


def compacted(spark: SparkSession, path: str, into: str, keys: list[str], order: list[str]) -> None:
    """The table of what is stored under path, one row a key, as batch -1 of a new path; later batches go on from there."""
    current_facts(spark.read.parquet(path).drop("batch"), keys, order).write.parquet(f"{into}/batch=-1")


def batches_of(folders: list[str]) -> set[int]:
    """Numbers of the batches that a version of upsert_versioned's table holds as folders of their own."""
    return {int(n.split("-")[1]) for n in folders if n.startswith("batch-")}


def compacted_to(folders: list[str]) -> int:
    """The last batch that is part of a compaction; -1 without one."""
    return max((int(n.split("-")[1]) for n in folders if n.startswith("upto-")), default=-1)


def upsert_versioned(table: Versioned, keys: list[str], order: list[str], compact_after: int = 0):
    """A foreachBatch function that adds each batch's last rows to a versioned table, whose current_facts is the upserted table.

    A batch is a folder that a commit names: readers see it whole or not at all, also while the table is compacted, which happens here
    once more than compact_after batches stand apart (0: never), or in another process. A batch that is run again is known by its
    number and changes nothing, even after it became part of a compaction.
    """

    def run(batch: DataFrame, number: int) -> None:
        name = f"batch-{number:012d}"
        there = table.folders(table.version())
        if number > compacted_to(there) and name not in there:
            table.write(current_facts(batch, keys, order), name)
            table.change(lambda now: [*now, name])
        if compact_after and len(batches_of(table.folders(table.version()))) > compact_after:
            compact(table, keys, order)

    return run


def compact(table: Versioned, keys: list[str], order: list[str]) -> int:
    """Make one folder, one row a key, of all folders of the last version; batches that came meanwhile stay beside it. The new version.

    The rows are written before a version names them, so that a reader of any version reads on; `clean` removes what is no longer named.
    """
    at = table.version()
    old = table.folders(at)
    if len(old) < 2:
        return at
    upto = max({compacted_to(old), *batches_of(old)})
    made = table.write(current_facts(table.read(at), keys, order), f"upto-{upto:012d}-{uuid.uuid4().hex}")
    return table.change(lambda now: [made, *(n for n in now if n not in old)])


def drained(stream: DataFrame, sink: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet, and read the result."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).option("path", sink).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(sink)
