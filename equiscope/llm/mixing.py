"""Operator 8: mixing sources to target weights by hash-random keys, prefix sums and exact budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiscope.llm.common import staged

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0) -> DataFrame:
    """(source, source_size) -> the same with target.

    Sources by code point, null last, weigh `weights`, repeating, and share `share` of all sizes; a target stops at `most`
    times the source's size and the excess is shared again by weight. That is one water level: with sources ordered by
    cap / weight, the level after the first k are full is (total - their caps) / (weight of the rest); it rises with k while
    sources overflow and falls after, so the greatest is the answer. One row per source, so one small window without partition.
    """
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(most)).withColumn("ratio", F.col("cap") / F.col("w"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, all_ = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = F.try_divide(
        F.sum("source_size").over(all_) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        F.sum("w").over(all_) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
    )
    s = s.withColumn("level", level)
    return s.withColumn("level", level).withColumn("level", F.max("level").over(all_)).select("source", "source_size", F.least(F.col("cap"), F.col("level") * F.col("w")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, share: float = 1.5, weights: tuple[float, ...] = (3, 1, 2), most: float = 2.0, seed: str = "mix", rows_per_range: int = 4_096) -> DataFrame:
    """Per row: id, size (words), source, source_size, target, taken (words the mix takes, repeats counted), epochs (whole times).

    Each document gets a hash-random key. Within its source the keys are cut into equal ranges (a range per rows_per_range
    rows of the table), each range is sorted, and the running word count is that of the earlier ranges plus that of the
    earlier rows, so that a hot source is spread over many tasks and no sort holds a whole source. The source's budget
    (its target, whole words) is met exactly: whole epochs first, then documents in key order, the last one in part.
    A null or wordless text has size 0 and gives 0; a null source is a source of its own, the last; repeated rows count each
    (ties go by id, then size); an empty table gives none. No document exceeds `most` times its size.
    """
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"), key.alias("key"))
    rows = staged(rows, "sizes")  # three passes follow, none over texts
    # the key's first 32 bits choose the range
    u = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    by_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(by_source.select("source", "source_size"), share, weights, most)
    n = by_source.agg(F.greatest(F.lit(1), F.ceil(F.sum("n") / F.lit(rows_per_range))).alias("ranges"))
    ranges = n.first()["ranges"] or 1
    rows = rows.withColumn("part", F.floor(u * ranges / F.lit(2**32)).cast("long"))
    part_sums = rows.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    earlier = F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = part_sums.select("source", "part", earlier.alias("offset")).join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    within = Window.partitionBy("source", "part").orderBy("key", F.col("id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    o = offsets.withColumnsRenamed({"source": "s", "part": "p"})
    both = rows.join(o, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("offset") - F.col("inside")
    return both.select(F.col("id").alias(id_col), F.col("size"), F.col("source").alias(source_col), "source_size", "target", (epochs * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest))).cast("long").alias("taken"), epochs.alias("epochs"))
