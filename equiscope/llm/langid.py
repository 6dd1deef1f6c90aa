"""Operator 5: language identification by averaged hashed subword embeddings and a linear softmax."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import byte_slices, utf8

SIZES = (1, 2, 3, 4)
_LOW = np.arange(256, dtype=np.uint32)
_LOW[65:91] += 32
_LOW[[9, 10, 11, 12, 13]] = 32
#: digits and ASCII punctuation say nothing of a language: blanks
_LOW[[*range(33, 65), *range(91, 97), *range(123, 127)]] = 32
_MULTIPLIERS = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917), np.uint32(668265263))


def subwords(data: np.ndarray, buckets: int) -> Iterator[np.ndarray]:
    """For each length, the bucket of the byte n-gram that starts at each place (blanks mark word ends)."""
    low = _LOW[data]
    h = np.zeros(len(low), np.uint32)
    for n in SIZES:
        if n > len(low):
            return
        h = h[: len(low) - n + 1] * np.uint32(16777619) + low[n - 1 :] * _MULTIPLIERS[n - 1]
        g = h ^ (h >> np.uint32(15))
        yield (g * np.uint32(2246822519) + np.uint32(n)) >> np.uint32(32 - int(buckets).bit_length() + 1)


def histogram(text: bytes, buckets: int, piece: int = 1 << 20) -> np.ndarray:
    """Shares of the buckets among the whole text's subwords."""
    out = np.zeros(buckets)
    most = max(SIZES) - 1
    for i in range(0, len(text), piece):
        data = np.frombuffer(text[i : i + piece + most], np.uint8)
        for n, g in enumerate(subwords(data, buckets)):
            out += np.bincount(g[: piece if i + piece < len(text) else None][: max(0, len(data) - n)], minlength=buckets)
    return (out / max(1, out.sum())).astype(np.float32)


def has_letter(text: bytes) -> bool:
    """Any letter at all; whole text, ASCII first."""
    if any(65 <= b <= 90 or 97 <= b <= 122 for b in text[:64]):
        return True
    data = np.frombuffer(text, np.uint8)
    low = data | 32
    if ((low >= 97) & (low <= 122) & (data < 128)).any():
        return True
    return bool((data >= 128).any()) and any(c.isalpha() for c in text.decode("utf-8", "replace"))


@dataclass
class LangModel:
    """Per bucket the product of its embedding and the softmax weights, of each language and then of the background, which stands
    for what is none of them; temperature and both bounds of the rejection from held-back training rows."""

    langs: list[str]
    table: np.ndarray  # buckets x (langs, background)
    bias: np.ndarray
    temperature: float
    floor: float  # the least probability of the best language among the languages
    foreign: float = 1.0  # the most that the background may have

    def judged(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, its probability, whether it is rejected) from rows of probabilities."""
        k = len(self.langs)
        own = p[:, :k]
        best, score = own.argmax(axis=1), own.max(axis=1)
        other = p[:, k] if p.shape[1] > k else np.zeros(len(p))
        return best, score, (other > self.foreign) | (score < self.floor * (1 - other))

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of whole texts, a row each."""
        buckets, k = self.table.shape
        means = np.zeros((len(texts), k))
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        for i, j in byte_slices(lengths, 1 << 19):
            if j == i + 1:
                means[i] = histogram(texts[i], buckets) @ self.table if lengths[i] else 0
                continue
            data = np.frombuffer(b"".join(texts[i:j]), np.uint8)
            ends = np.cumsum(lengths[i:j])
            starts = ends - lengths[i:j]
            total, count = np.zeros((j - i, k)), np.zeros(j - i)
            for n, g in enumerate(subwords(data, buckets), 1):
                last = np.maximum(ends - n + 1, starts)
                count += last - starts
                edge = np.minimum(np.stack([starts, last], 1).ravel(), len(g))
                for c in range(k):
                    run = np.concatenate([[0.0], np.cumsum(self.table[:, c][g], dtype=np.float64)])
                    total[:, c] += run[edge[1::2]] - run[edge[::2]]
            means[i:j] = total / np.maximum(count, 1)[:, None]
        return self.probabilities(means)


def train(x: np.ndarray, y: np.ndarray, langs: list[str], dim: int = 16, epochs: int = 30, rate: float = 0.5, seed: int = 7, spare: float = 0.2, smooth: float = 0.05, refuse: float = 0.001) -> LangModel:
    """Stochastic gradient descent on embeddings and weights, over x (which is scaled in place); the spare rows set the temperature and the rejection bounds.

    The background class learns from rows whose subwords are dealt to other buckets: all of them, as in a foreign script, or all but
    the most frequent, as in a foreign language or noise in the same letters. The floor is the `refuse` quantile of the spare
    rows' best calibrated probabilities among those predicted right, at most 0.5, and the background may have what all but
    `refuse` of them give it, at least 0.5: rows that look like the learned languages stay, and rows between languages or foreign to all go.
    """
    rng = np.random.default_rng(seed)
    n, k = len(y), len(langs)
    order = rng.permutation(n)
    held, used = order[: int(n * spare)], order[int(n * spare) :]
    idf = 1.0 / (np.sqrt(x.mean(axis=0)) + 1e-3)
    x *= idf.astype(np.float32)  # in place: the sample is the largest thing the driver holds
    e = rng.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    w, b = rng.normal(0, 0.1, (dim, k + 1)).astype(np.float32), np.zeros(k + 1, np.float32)
    scale = idf.astype(np.float32)
    by_use = np.argsort(-x.mean(axis=0) / scale, kind="stable")

    def background(rows: np.ndarray) -> np.ndarray:
        """Rows with their subwords dealt anew, but for the few most frequent ones in every second row."""
        made = rows / scale
        for i, row in enumerate(made):
            free = by_use[rng.integers(16, 128) if i % 2 else 0 :]
            row[free] = row[rng.permutation(free)]
        return made * scale

    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        rng.shuffle(used)
        for i in range(0, len(used), 16):
            at = used[i : i + 16]
            rows = np.concatenate([x[at], background(x[at[:6]])])
            goal = np.append(y[at], np.full(len(rows) - len(at), k))
            hidden = rows @ e
            p = hidden @ w + b
            p = np.exp(p - p.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p -= smooth / (k + 1)
            p[np.arange(len(rows)), goal] -= 1 - smooth
            p /= len(rows)
            back = p @ w.T
            w -= step * (hidden.T @ p)
            b -= step * p.sum(axis=0)
            e -= step * (rows.T @ back)
    model = LangModel(langs, ((idf[:, None] * e) @ w).astype(np.float64), b.astype(np.float64), 1.0, 0.0)
    if len(held):
        means = x[held].astype(np.float64) @ (e @ w)
        losses = []
        for t in np.geomspace(0.25, 16, 37):
            model.temperature = float(t)
            losses.append((-np.log(model.probabilities(means)[np.arange(len(held)), y[held]] + 1e-12).mean(), float(t)))
        model.temperature = min(losses)[1]
        p = model.probabilities(means)
        best, score, _ = model.judged(p)
        right = best == y[held]
        if right.any():
            model.floor = float(min(0.5, np.quantile((score / (1 - p[:, k]))[right], refuse)))
            model.foreign = float(max(0.5, np.quantile(p[right, k], 1 - refuse)))
    return model


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


#: bounds the model, which holds a column of weights for each label
MOST_LABELS = 1024


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", *, sample: int = 3000, buckets: int = 4096, **how) -> LangModel:
    """A model learned from a sample of at most `sample` labelled rows, about as many of each language; more than MOST_LABELS labels are an error.

    Rows are chosen by a hash of their id, below a share per language that the counts of all rows give. Tasks turn whole texts
    into bucket shares, so the driver gets at most sample x buckets numbers. No labelled row with text: a model that knows `und` only.
    """
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), utf8(text_col).alias("_text")).filter("_lang is not null and octet_length(_text) > 0")
    counts = rows.groupBy("_lang").count().orderBy(F.desc("count"), "_lang").limit(MOST_LABELS + 1).collect()
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels in {lang_col}")
    langs = sorted(r["_lang"] for r in counts)
    if not langs:
        return LangModel(["und"], np.zeros((buckets, 1)), np.zeros(1), 1.0, 0.0)
    each = sample / len(langs)
    share = F.element_at(F.create_map(*(F.lit(v) for r in counts for v in (r["_lang"], min(1.0, each / r["count"])))), F.col("_lang"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("lang:"), F.col("_id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    place = {v: i for i, v in enumerate(langs)}

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [(histogram(v.as_py(), buckets) * 1024).astype(np.float16).tobytes() for v in b.column(2)]  # half of the driver's memory
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), b.column(1), pa.array(x, pa.binary()), b.column(3)], ["i", "l", "x", "h"])

    # an id that repeats very often could take more than its share: then the least hashes of whole rows stay, and the bound holds
    chosen = rows.filter(u < share).select("_id", "_lang", "_text", F.xxhash64("_id", "_lang", "_text").alias("_h")).mapInArrow(shares, "i string, l string, x binary, h long")
    chosen = chosen.orderBy("h", "i", "l").limit(2 * sample).toPandas().sort_values(["i", "l", "x"], kind="stable")
    if not len(chosen):
        return LangModel(["und"], np.zeros((buckets, 1)), np.zeros(1), 1.0, 0.0)
    y = np.array([place[v] for v in chosen["l"]])
    x = np.empty((len(chosen), buckets), np.float32)
    for i, row in enumerate(chosen.pop("x")):
        x[i] = np.frombuffer(row, np.float16)
    x /= 1024
    del chosen
    return train(x, y, langs, **how)


def predict(docs: DataFrame, model: LangModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns in keep (the id by default), lang_pred, score (calibrated probability), rejected (foreign to all
    languages, between them, or und; see train).

    A null text, or one without a letter, is `und` with score 0 and rejected. Repeated rows each give a row; an empty table
    none. Whole texts are read, in pieces where long.
    """
    keep = keep or [id_col]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spec = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", lang_pred string, score double, rejected boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            texts = [v.as_py() for v in b.column(len(keep))]
            known = [has_letter(t) for t in texts]
            best, score, refused = m.judged(m.predict(texts) if texts else np.zeros((0, len(m.langs))))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array([m.langs[k] if a else "und" for k, a in zip(best, known, strict=True)], pa.string()),
                 pa.array([float(s) if a else 0.0 for s, a in zip(score, known, strict=True)], pa.float64()),
                 pa.array([not a or m.langs[k] == "und" or bool(r) for k, r, a in zip(best, refused, known, strict=True)], pa.bool_())],
                [*keep, "lang_pred", "score", "rejected"],
            )

    return docs.select(*keep, utf8(text_col).alias("__text")).mapInArrow(run, spec)
