"""Ranked rows as JSON or CSV files that are there whole or not at all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from equiscope.sources.stage import staged

#: rows of one file; a screen's result is far below it and becomes one file with one header
ROWS_PER_FILE = 1_000_000


def put(rows: DataFrame, path: str, kind: str, order: list[str], rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write rows in order under path, replacing what is there, and give the number of files.

    The files are written beside the path and moved to it when they are all done, so a reader never meets a part of them. Up to
    rows_per_file rows are one file; more are dealt to several by ranges of the order, each a table of its own with a header.
    """
    if kind not in ("json", "csv"):
        raise ValueError(f"no sink for {kind}")
    spark, rows = rows.sparkSession, staged(rows, "ranked")
    files = max(1, -(-rows.count() // rows_per_file))
    made = f"{path.rstrip('/')}.{uuid.uuid4().hex}"
    parts = (rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, *order)).sortWithinPartitions(*order)
    writer = parts.write.option("ignoreNullFields", False)
    (writer.json if kind == "json" else writer.option("header", True).csv)(made)
    to, new = (spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p) for p in (path, made))
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(to, True)
    if not fs.rename(new, to):
        raise OSError(f"{made} could not be moved to {path}")
    return files


def get(like: DataFrame, path: str, kind: str) -> DataFrame:
    """What put wrote, with the schema of another frame."""
    reader = like.sparkSession.read.schema(like.schema)
    return reader.json(path) if kind == "json" else reader.option("header", True).csv(path)
