"""Operator 6: near-duplicates by one-permutation hashing, optimal densification, banded buckets and star candidates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import maybe_among, merged, mix, shingles, utf8, words_by_text
from equiscope.llm.components import components


class OnePermutation:
    """Signatures of sorted hash sets: the least hash of each bin, and empty bins filled from full ones by a bin's own hash walk."""

    def __init__(self, bands: int, rows: int):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        self.edges = np.array([(i << 64) // self.bins for i in range(self.bins)], np.uint64)
        self.salt = mix(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(hashes, self.edges)
        full = np.append(at[1:], len(hashes)) > at
        sig = hashes[np.minimum(at, len(hashes) - 1)]
        empty = np.flatnonzero(~full)
        step = np.uint64(1)
        donor = np.arange(self.bins)
        while len(empty):
            pick = (mix(empty.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + step) % np.uint64(self.bins)).astype(np.int64)
            good = full[pick]
            donor[empty[good]] = pick[good]
            empty = empty[~good]
            step += np.uint64(1)
        return sig[donor]

    def keys(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key per band; the band is part of the key."""
        sig = self.signature(hashes).reshape(self.bands, self.rows)
        key = self.salt.copy()
        for r in range(self.rows):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + sig[:, r])
        return key.view(np.int64)


def signatures(docs: DataFrame, bands: int, rows: int, size: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, n, fp, keys): the number of distinct shingles, a 128-bit print of the set, and the bands' bucket keys; keys null for no words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        op = OnePermutation(bands, rows)
        for b in batches:
            n, fp, keys = [], [], []
            for _, h in words_by_text([v.as_py() for v in b.column(1)]):
                s = shingles(h, size)
                n.append(len(s))
                fp.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                keys.append(op.keys(s) if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc", "n", "fp", "keys"])

    return docs.select(F.col(id_col), utf8(text_col).alias("_text")).mapInArrow(run, f"doc {kind}, n long, fp binary, keys array<long>")


def confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (c, d) whose whole shingle sets have 100 * intersection >= percent * union."""
    right = pairs.join(texts.select(F.col("doc").alias("d"), F.col("text").alias("dt")).hint("merge"), "d")
    both = right.hint("merge").join(texts.select(F.col("doc").alias("c"), F.col("text").alias("ct")).hint("merge"), "c")
    kind = pairs.schema["c"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple[bytes, np.ndarray] = (b"", np.zeros(0, np.uint64))
        for b in batches:
            keep = []
            right_sets = [shingles(h, size) for _, h in words_by_text([v.as_py() for v in b.column(3)])]
            for i, s in enumerate(right_sets):
                t = b.column(2)[i].as_py()
                if t != known[0]:  # a centre's rows come one after the other
                    known = (t, shingles(next(words_by_text([t]))[1], size))
                a = known[1]
                both_n = int(np.isin(s, a, assume_unique=True).sum())
                keep.append(100 * both_n >= percent * (len(a) + len(s) - both_n) and both_n > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["c", "d"]).filter(pa.array(keep, pa.bool_()))

    return both.select("c", "d", "ct", "dt").mapInArrow(run, f"c {kind}, d {kind}")


SLOTS = 1 << 20
#: prefix rows of one token and length class that one task sets against the rows that look for partners
ROWS_PER_WAY = 4096


def length_classes(percent: int) -> np.ndarray:
    """Least sizes of the length classes: a set finds partners that are no smaller in its own class and the next one only."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(edges[-1] * 100 // percent + 1)
    return np.array(edges, np.int64)


def left_over(left: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """(c, d): the pairs of `left` (doc, label) with different labels whose similarity can reach the bound, by an exact prefix filter.

    Shingles are ordered from rare to frequent (counts by hash slot, a fixed 1M of them; any order is exact). Of two sets of n <= m
    shingles that reach the bound, at least percent * 2n / (100 + percent) are shared, so the first shared shingle stands among the first
    n - that + 1 of the smaller and the first m - percent * m / 100 + 1 of the larger. Only the former, which are few, are found, and only
    the latter look for them, within two length classes: what a family shares comes after what its texts have alone, so texts of one
    template below the bound meet nowhere. Rows of a token that many share are dealt to ways of ROWS_PER_WAY.
    """
    kind = left.schema["doc"].dataType.simpleString()
    wanted = merged(left.select("doc", "label").distinct().join(texts, "doc"), "leftover")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(h, size) for _, h in words_by_text([v.as_py() for v in b.column(0)])]
            slot, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) % np.uint64(SLOTS), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int64)), pa.array(n.astype(np.int64))], ["slot", "n"])

    met = wanted.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()  # at most SLOTS rows
    often = np.zeros(SLOTS, np.int64)
    often[met["slot"].to_numpy()] = met["n"].to_numpy()
    shared = left.sparkSession.sparkContext.broadcast(often)

    edges = length_classes(percent) if percent < 100 else None

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, place, n, token = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.uint64)]
            early, band = [np.zeros(0, bool)], [np.zeros(0, np.int32)]
            for i, h in words_by_text([v.as_py() for v in b.column(2)]):
                s = shingles(h, size)
                k = len(s) - -(-len(s) * percent // 100) + 1
                first = s[np.lexsort((s, shared.value[(s % np.uint64(SLOTS)).astype(np.int64)]))[:k]]
                at.append(np.full(len(first), i))
                place.append(np.arange(len(first), dtype=np.int32))
                n.append(np.full(len(first), len(s), np.int32))
                token.append(first)
                early.append(np.arange(len(first)) <= len(s) - -(-len(s) * 2 * percent // (100 + percent)))
                band.append(np.full(len(first), len(s) if edges is None else np.searchsorted(edges, len(s), "right"), np.int32))
            at = pa.array(np.concatenate(at))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(np.concatenate(token).view(np.int64)), pa.array(np.concatenate(place)), pa.array(np.concatenate(n)), pa.array(np.concatenate(early)), pa.array(np.concatenate(band))], ["doc", "label", "token", "place", "n", "early", "band"])

    rows = wanted.select("doc", "label", "text").mapInArrow(prefixes, f"doc {kind}, label {kind}, token long, place int, n int, early boolean, band int")
    rows = merged(rows, "prefixes")
    found = rows.filter("early").drop("early")
    heads = found.groupBy("token", "band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.floor(F.count(F.lit(1)) / ROWS_PER_WAY).cast("int").alias("more"))
    heads = merged(heads, "heads")
    look = rows.drop("early").withColumn("band", F.explode(F.array("band", F.col("band") - 1))).join(heads, ["token", "band"])
    look = look.filter("lo <> label or hi <> label").withColumn("way", F.explode(F.sequence(F.lit(0), "more"))).select("token", "band", "way", *(F.col(x).alias(f"_{x}") for x in ("doc", "label", "place", "n")))
    found = found.join(heads.select("token", "band", "more"), ["token", "band"]).withColumn("way", F.pmod(F.hash("doc"), F.col("more") + 1))
    # overlap needed: o >= percent * (n + _n) / (100 + percent); what a shared place leaves is the most there can be
    most = F.least(F.col("n") - F.col("place"), F.col("_n") - F.col("_place"))
    near = (F.struct("n", "doc") < F.struct("_n", "_doc")) & (F.col("label") != F.col("_label")) & (most * (100 + percent) >= percent * (F.col("n") + F.col("_n")))
    met = look.hint("merge").join(found, ["token", "band", "way"]).filter(near)
    return met.select(F.least("doc", "_doc").alias("c"), F.greatest("doc", "_doc").alias("d")).distinct()


def named(links: DataFrame) -> DataFrame:
    """(doc, label): the smallest class that each linked class reaches."""
    return merged(components(links.select(F.col("c").alias("u"), F.col("d").alias("v"))).withColumnsRenamed({"id": "doc", "component": "label"}), "labels")


def near_duplicates(docs: DataFrame, *, bands: int = 26, rows: int = 5, size: int = 5, percent: int = 85, rounds: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id reachable over links, itself included), kept.

    Documents link when 100 * |A and B| >= percent * |A or B| over their distinct word shingles (A-Z lower-cased; fewer words than
    `size` make one shingle; no words: linked with nothing). Documents with the same shingle set form one class and only its
    smallest id goes on. Classes that share a bucket of any band are candidates: in the first round each bucket's most popular
    class (the one whose buckets are largest together) is tested against the others, so a bucket of m gives m - 1 pairs; later
    rounds take the next most popular class of the buckets whose classes are not all linked to one centre, against the classes
    that are not under its centre. What then still shares a bucket untested, under different components, goes through an exact
    prefix filter (left_over), so no candidate is given up. Every candidate is confirmed on whole sets. At similarity 0.85 a pair shares no bucket with probability 2e-7.
    Repeated rows fall into one class; null text counts as empty; rows with a null id get a null component and are not kept.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    sig = merged(signatures(docs, bands, rows, size, id_col, text_col), "signatures")
    classes = merged(sig.filter("fp is not null and doc is not null").groupBy("fp").agg(F.min("doc").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = sig.join(classes.select(F.col("rep").alias("doc"), F.col("fp").alias("f")), "doc").filter("fp = f").dropDuplicates(["doc"])
    entries = merged(reps.select("doc", "n", F.explode("keys").alias("key")), "entries")
    shared = entries.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1")
    hits = merged(entries.join(shared, "key"), "hits")
    fame = hits.groupBy("doc").agg(F.sum("m").alias("fame"))
    hits = merged(hits.join(fame, "doc").select("key", "doc", "n", "fame"), "famed")
    wanted = merged(hits.select("doc").distinct(), "wanted")
    near = docs.filter(maybe_among(wanted, "doc")(id_col))
    texts = merged(near.select(F.col(id_col).alias("doc"), utf8(text_col).alias("text")).join(wanted, "doc").dropDuplicates(["doc"]), "texts")
    links = tested = used = None
    for _ in range(rounds):
        rest = hits.withColumn("label", F.col("doc"))
        if links is not None:
            # a class linked to a centre goes under the centre's name; components are only needed at the end
            star = links.groupBy("d").agg(F.min("c").alias("label")).withColumnRenamed("d", "doc")
            rest = hits.join(star, "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        if used is not None:
            rest = rest.join(used.withColumn("was", F.lit(True)).withColumnRenamed("c", "doc").hint("merge"), ["key", "doc"], "left")
            several = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key").hint("merge")
            rest = merged(rest.join(several, "key"), "rest")
        fresh = rest if used is None else rest.filter("was is null")
        centre = fresh.groupBy("key").agg(F.max_by(F.struct(F.col("doc").alias("c"), F.col("n").alias("cn"), F.col("label").alias("cl")), F.struct("fame", F.hash("doc"), "doc")).alias("s")).select("key", "s.*")
        centre = merged(centre, "centres")
        pairs = rest.join(centre, "key").filter("label <> cl").filter(F.least("n", "cn") * 100 >= F.greatest("n", "cn") * percent).select("c", F.col("doc").alias("d")).distinct()
        if tested is not None:
            pairs = pairs.join(tested.hint("merge"), ["c", "d"], "left_anti")
        pairs = merged(pairs, "pairs")
        used = centre.select("key", "c") if used is None else used.unionByName(centre.select("key", "c"))
        if pairs.isEmpty():
            if centre.isEmpty():
                break
            continue
        both = pairs.unionByName(pairs.select(F.col("d").alias("c"), F.col("c").alias("d")))
        tested = both if tested is None else tested.unionByName(both)
        found = merged(confirmed(pairs, texts, size, percent), "links")
        links = found if links is None else links.unionByName(found)
    labels = None if links is None else named(links)
    if used is not None:
        # classes that were no centre of their bucket have not met each other there
        rest = hits.join(used.withColumnRenamed("c", "doc"), ["key", "doc"], "left_anti")
        rest = rest.withColumn("label", F.col("doc")) if labels is None else rest.join(labels.hint("merge"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
        several = rest.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("key").hint("merge")
        rest = merged(rest.join(several, "key").select("doc", "label").distinct(), "rest")
        if not rest.isEmpty():
            pairs = left_over(rest, texts, size, percent)
            pairs = merged(pairs if tested is None else pairs.join(tested.hint("merge"), ["c", "d"], "left_anti"), "pairs")
            found = merged(confirmed(pairs, texts, size, percent), "links")
            if not found.isEmpty():
                links = found if links is None else links.unionByName(found)
                labels = named(links)
    roots = classes.select("fp", "rep")
    if labels is not None:
        roots = roots.join(labels.select(F.col("doc").alias("rep"), "label"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("rep"))
    out = sig.join(roots.withColumnRenamed("rep", "root").hint("merge"), "fp", "left")
    component = F.when(F.col("doc").isNotNull(), F.coalesce("root", "doc")).cast(kind)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"))
