"""Intermediate tables in the folder that driver and executors share, which cut a plan's lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one and a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="equiscope-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return at


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again."""
    at = scratch(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


#: bytes beyond which Java does not compile a method but interprets it
HUGE_METHOD = "8000"


def compiled(df: DataFrame, name: str) -> DataFrame:
    """staged, for rows of dozens of fields: a stage whose generated code is one method too long for Java to compile is run operator by
    operator, whose projections are cut into methods."""
    conf, limit = df.sparkSession.conf, "spark.sql.codegen.hugeMethodLimit"
    before = conf.get(limit)
    conf.set(limit, HUGE_METHOD)
    try:
        return staged(df, name)
    finally:
        conf.set(limit, before)
