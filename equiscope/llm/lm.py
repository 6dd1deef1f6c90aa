"""Operator 7: document log-likelihood under a gated recurrent language model, over corpus-wide word counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscope.llm import gru
from equiscope.llm.common import staged, utf8, words_by_text

#: the hash that stands for the end of a text
END = np.uint64(0x5EED0E0DF7E75EED)


def tokens(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes of each text, then the end."""
    return [np.append(h, END) for _, h in words_by_text(texts)]


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, c): how often each word hash occurs; summed in each batch, then over the cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [np.full(b.num_rows, END, np.uint64)]
            found += [h for _, h in words_by_text([v.as_py() for v in b.column(0)])]
            word, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "c"])

    return docs.select(utf8(text_col).alias("_text")).mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """The most frequent words (at most a set number) with their counts, by hash; the first `listed` of them have ids."""

    words: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    listed: int

    def look_up(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, id) of each hash: count -1 if it is not among the frequent words, id `listed` if it has none."""
        if not len(self.words):
            return np.full(len(h), -1), np.full(len(h), self.listed)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        here = self.words[at] == h
        return np.where(here, self.counts[at], -1), np.where(here, self.ids[at], self.listed)


def vocabulary(counts: DataFrame, frequent: int, listed: int) -> tuple[Vocabulary, np.ndarray]:
    """The vocabulary, and the counts of the listed words in order; the end is always listed."""
    end = int(END.view(np.int64))
    top = counts.orderBy((F.col("word") == end).desc(), F.desc("c"), "word").limit(frequent).toPandas()
    word, c = top["word"].to_numpy(np.int64), top["c"].to_numpy(np.int64)
    rank = np.argsort(-c, kind="stable")
    if len(word) > listed and (pos := int(np.flatnonzero(rank == 0)[0])) >= listed:  # the end, first in top, last of the list
        rank = np.concatenate([rank[: listed - 1], [0], np.delete(rank, pos)[listed - 1 :]])
    word, c = word[rank], c[rank]
    n = min(listed, len(word))
    ids = np.where(np.arange(len(word)) < n, np.arange(len(word)), n)
    order = np.argsort(word.view(np.uint64), kind="stable")
    return Vocabulary(word.view(np.uint64)[order], c[order], ids[order], n), c[:n]


def chance(id_col: str, salt: str) -> Column:
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long") / F.lit(2**32)


#: parts of a weight vector that are summed over shards apart from each other
CHUNKS = 64


def _sum_by_chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of (chunk, v, n) rows, one at a time, so that a task holds one vector for each chunk whatever the number of shards."""
    total: dict[int, list] = {}
    for b in batches:
        for c, v, n in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            row = np.frombuffer(v.as_buffer(), np.float32).astype(np.float64) * n
            held = total.setdefault(c, [np.zeros(len(row)), 0.0])
            held[0] += row
            held[1] += n
    if total:
        cols = pa.array(list(total)), pa.array([(v / n).astype(np.float32).tobytes() for v, n in total.values()], pa.binary()), pa.array([n for _, n in total.values()])
        yield pa.RecordBatch.from_arrays(list(cols), ["chunk", "v", "n"])


def sequences(docs: DataFrame, vocab: Vocabulary, text_col: str, rounds: int, u: Column) -> DataFrame:
    """(round, ids): the word ids of every document, written once; u in [0, 1) gives the round."""
    words = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = [words.value.look_up(h)[1].astype(np.int32).tobytes() for h in tokens([v.as_py() for v in b.column(1)])]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], ["round", "ids"])

    made = docs.select(F.least(F.floor(u * rounds), F.lit(rounds - 1)).cast("int").alias("round"), utf8(text_col).alias("_text")).mapInArrow(run, "round int, ids binary")
    return staged(made.sortWithinPartitions("round"), "sequences")


def fit(docs: DataFrame, vocab: Vocabulary, model: gru.Gru, id_col: str, text_col: str, *, fraction: float, docs_per_shard: int) -> gru.Gru:
    """The model after one pass over all documents: each round, shards of documents train copies of it in parallel, and the weights are averaged.

    Each round reads another slice, a `fraction` of the documents by a hash of the id, until all are read once; shards hold
    docs_per_shard documents on average, dealt in turn. Averages are summed chunk by chunk of the weight vector, and the driver
    gets one vector a round.
    """
    rounds = max(1, math.ceil(1 / fraction))
    every = sequences(docs, vocab, text_col, rounds, chance(id_col, "lm:"))
    shards = max(1, math.ceil(every.count() / rounds / docs_per_shard))
    for k in range(rounds):
        at = docs.sparkSession.sparkContext.broadcast(model)
        rate = 0.03 * (1 - 0.7 * k / rounds)

        def run(batches: Iterator[pa.RecordBatch], at=at, rate=rate) -> Iterator[pa.RecordBatch]:
            own = [np.frombuffer(v.as_buffer(), np.int32) for b in batches for v in b.column(0)]
            if own:
                parts = np.array_split(gru.train(at.value, own, rate).vector(), CHUNKS)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS)), pa.array([p.tobytes() for p in parts], pa.binary()), pa.array(np.full(CHUNKS, float(sum(map(len, own)))))], ["chunk", "v", "n"])

        shape = "chunk long, v binary, n double"
        mean = every.filter(F.col("round") == k).select("ids").repartition(shards).mapInArrow(run, shape).repartition(min(shards, CHUNKS), "chunk").mapInArrow(_sum_by_chunk, shape)
        found = sorted((r["chunk"], bytes(r["v"])) for r in mean.collect())  # one vector, in CHUNKS parts
        if found:
            model = model.with_vector(np.frombuffer(b"".join(v for _, v in found), np.float32))
        at.unpersist()
    return model


def scores(
    docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, *,
    listed: int = 1024, frequent: int = 1 << 16, hidden: int = 16, per_class: int = 32, fraction: float = 0.125, docs_per_shard: int = 1000,
) -> DataFrame:
    """Per row of docs: the columns in keep, n_tokens, n_known, train_tokens, base_score, score (both log10), learned from `train`.

    Tokens: words [^\\x20\\x09-\\x0D]+ with A-Z lower-cased (64-bit hashes), then one end. Counts c, their sum N and number V come from
    all of train, and the recurrent model reads all of it once, in 1 / fraction rounds. base_score: sum of log10((c + 0.5) / (N + 0.5 (V + 1))). score: the recurrent model gives P(class), P(word | class)
    for the `listed` most frequent words and P(outside the list); a word outside has (c + 0.5) / (that mass), where one unseen
    word stands for all, so the probabilities of what can follow add up to one. Counts of the `frequent` most frequent words are
    broadcast (a fixed bound); the other words of each document are joined with the counts. A null text is its end alone; repeated
    rows each give a row; an empty docs gives none; with an empty train all counts are 0.
    """
    spark = docs.sparkSession
    keep = keep or [id_col]
    counts = staged(word_counts(train, text_col), "counts")
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).first()
    big_n, big_v = total["n"] or 0, total["v"]
    vocab, c_listed = vocabulary(counts, frequent, listed)
    outside = (big_n - int(c_listed.sum())) + 0.5 * (big_v - vocab.listed) + 0.5
    model = gru.Gru.start(c_listed if vocab.listed else np.zeros(1), outside, hidden, per_class)
    if vocab.listed:
        model = fit(train, vocab, model, id_col, text_col, fraction=fraction, docs_per_shard=docs_per_shard)
    else:
        vocab = Vocabulary(np.array([END]), np.zeros(1, np.int64), np.zeros(1, np.int64), 1)
    words, best = spark.sparkContext.broadcast(vocab), spark.sparkContext.broadcast(model)
    spec = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = words.value, best.value
        row = TaskContext.get().partitionId() << 36
        for b in batches:
            for i in range(0, b.num_rows, 10000):
                part = b.slice(i, 10000)
                docs_ = tokens([x.as_py() for x in part.column(len(keep))])
                ids, stats, rare, times = [], [], [], []
                for h in docs_:
                    c, k = v.look_up(h)
                    logs = np.log10(c[c >= 0] + 0.5)
                    unlisted = k[c >= 0] == v.listed
                    ids.append(k.astype(np.int32))
                    stats.append((len(h), int((c > 0).sum()), float(logs.sum()), float(logs[unlisted].sum()), int((k == v.listed).sum())))
                    word, n = np.unique(h[c < 0], return_counts=True)
                    rare.append(word.view(np.int64))
                    times.append(n.astype(np.int32))
                p = gru.score(m, ids) / math.log(10)
                cols = list(zip(*stats, strict=True))
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(k) for k in range(len(keep))), pa.array(np.arange(row, row + len(p))), *(pa.array(x, k) for x, k in zip(cols, kinds, strict=True)), pa.array(p), pa.array(rare, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))],
                    [*keep, "_row", "n_tokens", "_known", "_all", "_tail", "_out", "_gru", "_rare", "_times"],
                )
                row += len(p)

    out = docs.select(*keep, utf8(text_col).alias("__text")).mapInArrow(run, f"{spec}, _row long, n_tokens long, _known long, _all double, _tail double, _out long, _gru double, _rare array<long>, _times array<int>")
    out = staged(out, "scored")
    each = out.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("x")).select("_row", F.col("x._rare").alias("word"), F.col("x._times").alias("k"))
    met = each.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rare = met.groupBy("_row").agg(F.sum(F.col("k") * F.log10(F.col("c") + 0.5)).alias("_rare_logs"), F.sum(F.when(F.col("c") > 0, F.col("k")).otherwise(0)).alias("_rare_known"))
    out = out.drop("_rare", "_times").join(rare, "_row", "left")
    logs = F.coalesce("_rare_logs", F.lit(0.0))
    return out.select(
        *keep, "n_tokens", (F.col("_known") + F.coalesce("_rare_known", F.lit(0))).alias("n_known"), F.lit(big_n).cast("long").alias("train_tokens"),
        (F.col("_all") + logs - F.col("n_tokens") * math.log10(big_n + 0.5 * (big_v + 1))).alias("base_score"),
        (F.col("_gru") + F.col("_tail") + logs - F.col("_out") * math.log10(outside)).alias("score"),
    )
