"""Operator 3: exact dedup against a persistent digest index, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiscope.llm.common import shared_dir, staged, utf8


#: digests that a bucket of a new index is made for; more documents than that get more buckets
PER_BUCKET = 1_000_000


def buckets_for(rows: int) -> int:
    """Buckets of a new index for so many rows: a power of two from 64 to 65,536."""
    return 1 << min(16, max(6, (max(1, rows - 1) // PER_BUCKET).bit_length()))


class DigestIndex:
    """One row per digest ever kept: (digest, keep_id), in a table bucketed and sorted by digest.

    The files stay at `location`; a later session that opens the same location goes on with the same index. New data are
    matched by a sort-merge anti-join, for which the index side needs neither shuffle nor sort, and then appended.
    """

    def __init__(self, spark: SparkSession, location: str | None = None, buckets: int = 64, id_type: str = "bigint"):
        self.spark, self.buckets = spark, buckets
        self.location = location or f"{shared_dir(spark)}/digests-{uuid.uuid4().hex}"
        self.name = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.location}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, groups: DataFrame) -> DataFrame:
        """Append the groups (digest, keep_id, group_size; one row per digest) that the index lacks; return the index.

        A bucket is one task's, so an append adds one file to it.
        """
        new = groups.hint("merge").join(self.table().hint("merge"), "digest", "left_anti")
        bucket = F.pmod(F.hash("digest"), F.lit(self.buckets))  # as the table deals its rows
        (
            new.select("digest", "keep_id", "group_size").repartitionById(self.buckets, bucket).sortWithinPartitions("digest")
            .write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )
        return self.table()


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Per row: id, keep_id, group_size, kept, text_sha256, in_index.

    Texts are equal when their bytes are; null counts as empty. Of equal texts in this batch the largest id stays; a digest that
    the index already held keeps the id it was stored with, and then no row of the batch stays (in_index is true). group_size
    counts the batch's rows. Rows with a null id are grouped too; if all of a group are null its keep_id is null and none stays.
    Repeated rows (same id and text) all carry kept = true, as they name the same document; an empty table gives no rows;
    other columns are not read. Groups are summed before the shuffle. Digests of groups with a thousandth or more of the rows
    (at most 1000 of them) are looked up by broadcast, all others by merge join, so no task holds one group. Where no index is given, one is made,
    with `buckets` buckets or as many as the rows call for.
    """
    spark = docs.sparkSession
    rows = staged(docs.select(F.col(id_col).alias("_id"), F.unhex(F.sha2(utf8(text_col), 256)).alias("digest")), "digests")
    total = rows.count()
    index = index or DigestIndex(spark, buckets=buckets or buckets_for(total), id_type=docs.schema[id_col].dataType.simpleString())
    groups = staged(rows.groupBy("digest").agg(F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
    before = index.table().select("digest", F.lit(True).alias("in_index"))
    known = staged(groups.select("digest").hint("merge").join(before.hint("merge"), "digest"), "known")
    kept = index.add(groups)
    seen = groups.select("digest", "group_size").hint("merge").join(kept.select("digest", "keep_id").hint("merge"), "digest")
    seen = staged(seen.hint("merge").join(known.hint("merge"), "digest", "left"), "seen")
    hot = F.col("group_size") >= max(2, -(-total // 1000))
    many = seen.filter(hot)
    left = rows.join(F.broadcast(many.select("digest", F.struct("keep_id", "group_size", "in_index").alias("hit"))), "digest", "left")
    cold = left.filter(F.col("hit").isNull()).drop("hit").hint("merge").join(seen.filter(~hot).hint("merge"), "digest")
    warm = left.filter(F.col("hit").isNotNull()).select("digest", "_id", "hit.*")
    out = warm.unionByName(cold.select(*warm.columns))
    in_index = F.coalesce("in_index", F.lit(False))
    return out.select(
        F.col("_id").alias(id_col), "keep_id", "group_size", F.coalesce(~in_index & (F.col("_id") == F.col("keep_id")), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"), in_index.alias("in_index"),
    )
