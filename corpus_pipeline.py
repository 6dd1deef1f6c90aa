"""documents -> language ID -> exact dedup -> near dedup -> benchmark decontamination -> mix to target weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscope.llm import decontaminate, exact, langid, minhash, mixing
from equiscope.llm.common import staged


def free(docs: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def with_key(docs: DataFrame, name: str, null_last: bool) -> DataFrame:
    """docs with a key: the id, or for a row without one a hash of its columns, beyond all other ids on one side."""
    h = F.pmod(F.xxhash64(*docs.columns), F.lit(1 << 61)) + F.lit(1 << 62)
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast("long"), h if null_last else -h))


def judged(docs: DataFrame, judge: Callable[[DataFrame], DataFrame], null_last: bool) -> DataFrame:
    """The rows whose ids `judge` gives; rows of one id with different texts stay or go together, and stay if one of them does."""
    key = free(docs, "_id")
    keyed = with_key(docs, key, null_last)
    kept = judge(keyed.withColumn("doc_id", F.col(key)).select(docs.columns)).select(F.col("doc_id").alias(key)).distinct()
    return keyed.join(kept, key, "left_semi").select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the language model, learned from the labelled rows that are not held out, rejects.

    A null text, or one without a letter, is rejected; rows without an id are judged as any other; repeated rows all stay.
    Columns go by place past the prediction, so that none of theirs can meet one of its own.
    """
    model = langid.fit(docs.filter(~langid.held_out()))
    places = [f"c{i}" for i in range(len(docs.columns))]
    text = places[docs.columns.index("text")]
    return langid.predict(docs.toDF(*places), model, text_col=text, keep=places).filter(~F.col("rejected")).select(places).toDF(*docs.columns)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of equal texts the row with the largest doc_id, once if it repeats; one without an id only if no other has its text.

    Null counts as the empty text. A row is told by its id and text, so rows of one id with other texts are judged apart.
    """
    key, text = free(docs, "_id"), free(docs, "_text")
    keyed = with_key(docs, key, null_last=False).withColumn(text, F.sha2(F.coalesce("text", F.lit("")), 256))
    kept = exact.exact_dedup(keyed.withColumn("doc_id", F.col(key)).select(docs.columns)).filter("kept")
    kept = kept.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(text)).distinct()
    return keyed.join(kept, [key, text], "left_semi").dropDuplicates([key, text]).select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates; a row without an id only if no other is in its group.

    A text without words is near to nothing and stays.
    """
    return judged(docs, lambda d: minhash.near_duplicates(d).filter("kept"), null_last=True)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents; the others, those without words too, stay as they are."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return judged(docs, lambda d: decontaminate.contamination(d, bench).filter("not contaminated"), null_last=True)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document how many of its words the mix takes; a null text has none, a null source is a source."""
    return mixing.mix_sources(docs).select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [("language_id", language), ("exact_dedup", exact_copies), ("near_dedup", near_copies), ("decontamination", benchmark_free), ("mixing", mixed)]

#: language ID is a trained model, which SQL can't express; tests/llm holds the other stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = staged(docs, f"pipeline-{name}")
    return docs
