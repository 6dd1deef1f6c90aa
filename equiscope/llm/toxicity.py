"""Operator 12: toxicity by a convolutional text classifier over hashed word embeddings."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import LOWER, byte_slices, mix, prefix_hash, span_hash, utf8

WIDTHS = (1, 2, 3)
#: a word's embedding is the sum of the rows of the whole word and of its first bytes, for languages that build words from stems
STEMS = (4, 6)
PARTS = 1 + len(STEMS)
#: words are runs of letters and of bytes beyond ASCII, so that marks around a word are no part of it
_LOW = np.frombuffer(LOWER, np.uint8)
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def words(buffer: bytes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(words x PARTS buckets, the byte at which each word starts) of a buffer."""
    data = _LOW[np.frombuffer(buffer, np.uint8)]
    edge = np.diff(np.concatenate([[0], _LETTER[data].astype(np.int8), [0]]))
    s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    p = prefix_hash(data)
    ends = [e, *(np.minimum(e, s + k) for k in STEMS)]
    h = [mix(span_hash(p, s, to) + np.uint64(k)) % np.uint64(buckets) for k, to in enumerate(ends)]
    return np.stack(h, axis=1).astype(np.int32) if len(s) else np.zeros((0, PARTS), np.int32), s


def tokens_of(texts: list[bytes], buckets: int, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(i, j, words x PARTS, counts by text) of texts i..j; a long text comes alone and whole, its words hashed in pieces."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    for i, j in byte_slices(lengths, limit):
        if j == i + 1 and lengths[i] > limit:
            parts, at, text = [], 0, texts[i]
            while at < len(text):
                to = at + limit
                while to < len(text) and _LETTER[_LOW[text[to]]]:
                    to += 1
                parts.append(words(text[at:to], buckets)[0])
                at = to
            w = np.concatenate(parts)
            yield i, j, w, np.array([len(w)])
            continue
        w, s = words(b" ".join(texts[i:j]), buckets)
        edge = np.searchsorted(s, np.concatenate([[0], np.cumsum(lengths[i:j] + 1)]))
        yield i, j, w, np.diff(edge)


def padded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the words in a row that leaves room for the widest filter behind every text, first place of each text)."""
    starts = np.concatenate([[0], np.cumsum(counts + max(WIDTHS))])
    at = np.arange(int(counts.sum())) + np.repeat(starts[:-1] - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
    return at, starts


@dataclass
class ToxModel:
    """Embeddings already multiplied with every filter row: convolving is gathering and adding. Scores are calibrated so that
    each language's threshold is 0.5."""

    table: np.ndarray  # buckets x (filter rows of all widths)
    bias: np.ndarray  # a filter each
    out: np.ndarray
    offset: float
    lang_table: np.ndarray  # buckets x languages, mean log shares of whole words
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))
    slope: float = 1.0

    def pooled(self, w: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The largest response of each filter in each text."""
        f = len(self.bias) // len(WIDTHS)
        at, starts = padded(counts)
        rows = np.zeros((int(starts[-1]), self.table.shape[1]), np.float32)
        if len(w):
            rows[at] = self.table[w[:, 0]] + self.table[w[:, 1]] + self.table[w[:, 2]]
        top, col = np.empty((len(counts), len(self.bias)), np.float32), 0
        for k, width in enumerate(WIDTHS):
            conv = rows[:, col : col + f].copy()
            for o in range(1, width):
                conv[:-o] += rows[o:, col + o * f : col + (o + 1) * f]
            # windows start at a text's words and at the blank behind them, so a text without words has one
            own = np.stack([starts[:-1], starts[:-1] + counts + 1], axis=1).ravel()
            top[:, k * f : (k + 1) * f] = np.maximum.reduceat(conv, np.minimum(own, len(conv) - 1))[::2]
            col += width * f
        return top

    def raw(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(logit, language) of every whole text; the language is that of its words."""
        z, lang = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for i, j, w, counts in tokens_of(texts, len(self.table)):
            z[i:j] = np.maximum(self.pooled(w, counts) + self.bias, 0) @ self.out + self.offset
            run = np.concatenate([np.zeros((1, self.lang_table.shape[1])), np.cumsum(self.lang_table[w[:, 0]], axis=0, dtype=np.float64)])
            ends = np.cumsum(counts)
            lang[i:j] = (run[ends] - run[ends - counts]).argmax(axis=1)
        return z, lang

    def scores(self, texts: list[bytes]) -> np.ndarray:
        z, lang = self.raw(texts)
        return 1 / (1 + np.exp(-np.clip(self.slope * (z - self.thresholds[lang]), -30, 30)))


def best_threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The cut with the best F1 among weighted rows; in the middle of the gap that it falls into."""
    order = np.argsort(-z, kind="stable")
    z, hit, w = z[order], y[order] * weight[order], weight[order]
    found, given = np.cumsum(hit), np.cumsum(w)
    f1 = 2 * found / (given + hit.sum())
    f1[:-1][z[:-1] == z[1:]] = -1  # a cut can't part equal values
    i = int(f1.argmax())
    return float((z[i] + z[i + 1]) / 2) if i + 1 < len(z) else float(z[i] - 1)


def train(
    docs: list[np.ndarray], y: np.ndarray, lang: np.ndarray, weight: np.ndarray, langs: int, *,
    buckets: int, dim: int = 12, filters: int = 8, epochs: int = 8, rate: float = 0.05, batch: int = 32, spare: float = 0.25, least: int = 20, seed: int = 11,
) -> ToxModel:
    """Fit by stochastic gradients (Adagrad) on embeddings, filters and output; the spare rows set the slope and the thresholds.

    One coordinate of a bucket's embedding starts at the smoothed log odds of its label, the others small and random. Only the
    windows that were the largest of their text pass a gradient. A language with fewer than `least` spare rows of either label
    takes the threshold of all.
    """
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: int(len(y) * spare)], order[int(len(y) * spare) :]
    seen = np.zeros((2, buckets))
    shares = np.full((buckets, max(1, langs)), 0.1)
    for k in used:
        present = np.unique(docs[k])
        seen[int(y[k]), present] += 1
        np.add.at(shares[:, lang[k]], docs[k][:, 0], 1.0)
    odds = np.log((seen[1] + 2) / ((y[used] == 1).sum() + 4)) - np.log((seen[0] + 2) / ((y[used] == 0).sum() + 4))
    shares = np.log(shares / shares.sum(axis=0))
    rare = seen.sum(axis=0) < 3
    odds[rare] = 0.0
    shares -= shares.mean(axis=1, keepdims=True)

    e = rng.normal(0, 0.05, (buckets, dim)).astype(np.float32)
    e[:, 0] = odds
    w = [rng.normal(0, 0.1, (width * dim, filters)).astype(np.float32) for width in WIDTHS]
    for m in w:
        m[0] += 0.5
    b = [np.zeros(filters, np.float32) for _ in WIDTHS]
    out, offset = np.full(len(WIDTHS) * filters, 0.1, np.float32), np.float32(-1.0)
    sums = [np.full(m.shape, 1e-3, np.float32) for m in (*w, *b, out)] + [1e-3]
    e_sum = np.full(e.shape, 1e-3, np.float32)

    def step(param: np.ndarray, grad: np.ndarray, k: int) -> None:
        sums[k] += grad * grad
        param -= rate * grad / np.sqrt(sums[k])

    for _ in range(epochs):
        rng.shuffle(used)
        for i in range(0, len(used), batch):
            at = used[i : i + batch]
            toks, counts = np.concatenate([docs[k] for k in at]), np.array([len(docs[k]) for k in at])
            place, starts = padded(counts)
            x = np.zeros((int(starts[-1]), dim), np.float32)
            x[place] = e[toks].sum(axis=1)
            back_to = np.full(len(x), -1)
            back_to[place] = np.arange(len(toks))
            pooled, arg = [], []
            for m, width in zip(w, WIDTHS, strict=True):
                conv = sum(np.pad(x[o:], ((0, o), (0, 0))) @ m[o * dim : (o + 1) * dim] for o in range(width))
                top = [conv[s : s + c + 1].argmax(axis=0) + s for s, c in zip(starts[:-1], counts, strict=True)]
                arg.append(np.stack(top))
                pooled.append(np.take_along_axis(conv, arg[-1], axis=0))
            act = np.maximum(np.concatenate(pooled, axis=1) + np.concatenate(b), 0)
            p = 1 / (1 + np.exp(-np.clip(act @ out + offset, -30, 30)))
            d = ((p - y[at]) / len(at)).astype(np.float32)
            d_act = (d[:, None] * out) * (act > 0)
            step(out, act.T @ d + 1e-4 * out, 2 * len(WIDTHS))
            sums[-1] += float(d.sum()) ** 2
            offset -= np.float32(rate * d.sum() / np.sqrt(sums[-1]))
            d_x = np.zeros_like(x)
            for k, width in enumerate(WIDTHS):
                g = d_act[:, k * filters : (k + 1) * filters]
                d_w = np.empty_like(w[k])
                for o in range(width):
                    src = x[np.minimum(arg[k] + o, len(x) - 1)]  # texts x filters x dim
                    d_w[o * dim : (o + 1) * dim] = np.einsum("bf,bfd->df", g, src)
                    np.add.at(d_x, np.minimum(arg[k] + o, len(x) - 1), g[:, :, None] * w[k][o * dim : (o + 1) * dim].T[None])
                step(w[k], d_w + 1e-4 * w[k], k)
                step(b[k], g.sum(axis=0), len(WIDTHS) + k)
            hit = np.flatnonzero(np.abs(d_x).any(axis=1) & (back_to >= 0))
            rows, grad = toks[back_to[hit]].ravel(), np.repeat(d_x[hit], PARTS, axis=0)
            if len(rows):
                which, slot = np.unique(rows, return_inverse=True)
                total = np.zeros((len(which), dim), np.float32)
                np.add.at(total, slot, grad)
                e_sum[which] += total * total
                e[which] -= rate * total / np.sqrt(e_sum[which])

    table = np.concatenate([e @ m[o * dim : (o + 1) * dim] for m, width in zip(w, WIDTHS, strict=True) for o in range(width)], axis=1)
    model = ToxModel(table, np.concatenate(b), out.astype(np.float64), float(offset), shares.astype(np.float32), np.zeros(max(1, langs)))
    if len(held) and 0 < y[held].sum() < len(held):
        z = np.array([float((np.maximum(model.pooled(docs[k], np.array([len(docs[k])])) + model.bias, 0) @ model.out)[0] + model.offset) for k in held])
        spread = np.abs(z - np.median(z)).mean()
        model.slope = float(4 / max(spread, 1e-3))
        model.thresholds[:] = best_threshold(z, y[held], weight[held])
        for k in range(langs):
            own = lang[held] == k
            if min(y[held][own].sum(), (1 - y[held][own]).sum()) >= least:
                model.thresholds[k] = best_threshold(z[own], y[held][own], weight[held][own])
    return model


def blank(buckets: int = 2, score: float = 0.0) -> ToxModel:
    """The model without labelled rows: nothing is toxic."""
    f = len(WIDTHS)
    return ToxModel(np.zeros((buckets, sum(WIDTHS)), np.float32), np.zeros(f), np.zeros(f), -20.0, np.zeros((buckets, 1), np.float32))


#: rows without a language, and languages beyond the most frequent, share one
MOST_LANGS = 64


def fit(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", lang_col: str = "lang", *,
    sample: int = 4000, sample_bytes: int = 1 << 26, buckets: int = 1 << 17, **how,
) -> ToxModel:
    """A model learned from whole labelled texts: at most `sample` rows and `sample_bytes` of text, shared among languages and labels.

    Rows are chosen by a hash of their id below a share per (language, label) that the counts of all labelled rows give; what
    exceeds the bounds goes by the hash. An id with several labels counts by its largest, a null label or id not at all.
    The thresholds weigh each row by what it stands for. Texts come to the driver as word buckets.
    """
    marked = labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max((F.col(label_col) > 0).cast("int")).alias("_y"))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(lang_col, F.lit("")).alias("_lang"), utf8(text_col).alias("_text"))
    known = rows.select("_id", "_lang", F.octet_length("_text").alias("_n")).join(marked, "_id")
    counts = known.groupBy("_lang", "_y").count().orderBy(F.desc("count"), "_lang", "_y").limit(2 * MOST_LANGS).collect()
    langs = sorted({r["_lang"] for r in counts})
    if not langs:
        return blank()
    each = sample / len(counts)
    stands_for = {(r["_lang"], r["_y"]): max(1.0, r["count"] / each) for r in counts}
    times = F.element_at(F.create_map(*(F.lit(v) for (lang, y), n in stands_for.items() for v in (f"{y}{lang}", n))), F.concat(F.col("_y").cast("string"), "_lang"))
    u = F.conv(F.substring(F.md5(F.concat(F.lit("tox:"), F.col("_id").cast("string"))), 1, 8), 16, 10).cast("long") / F.lit(2**32)
    picked = known.withColumn("_u", u * times).filter("_u < 1").orderBy("_u", "_id", "_lang", "_n").limit(2 * sample).toPandas()
    picked = picked[picked["_n"].cumsum() <= sample_bytes].drop_duplicates("_id")
    if not len(picked):
        return blank()
    ids = docs.sparkSession.createDataFrame(picked[["_id", "_y"]], known.select("_id", "_y").schema)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = [np.concatenate([x for _, _, x, _ in tokens_of([t.as_py()], buckets)] or [np.zeros((0, PARTS), np.int32)]).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(w, pa.binary())], ["i", "y", "l", "w"])

    kind = docs.schema[id_col].dataType.simpleString()
    chosen = rows.join(F.broadcast(ids), "_id").select("_id", "_y", "_lang", "_text")  # at most 2 x sample ids
    # an id that repeats brings its first rows only, so the bound holds
    found = chosen.mapInArrow(hashed, f"i {kind}, y int, l string, w binary").orderBy("i", "l", "w").limit(2 * sample).toPandas()
    tokens = [np.frombuffer(x, np.int32).reshape(-1, PARTS) for x in found["w"]]
    place = {v: k for k, v in enumerate(langs)}
    lang = np.array([place.get(v, 0) for v in found["l"]])
    weight = np.array([stands_for.get((v, y), 1.0) for v, y in zip(found["l"], found["y"], strict=True)])
    return train(tokens, found["y"].to_numpy(np.int64), lang, weight, len(langs), buckets=buckets, **how)


def predict(docs: DataFrame, model: ToxModel, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Per row: the columns in keep (the id by default), score and predicted (1 where the score is 0.5 or more).

    A null text counts as empty; a text without words scores by the filters' response to blanks. Repeated rows each give a row; an
    empty table none. Whole texts are read; nothing but the text is an input. The model is a broadcast of buckets x filter rows numbers.
    """
    keep = keep or ["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spec = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep) + ", score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [v.as_py() for v in b.column(len(keep))]
            scores = shared.value.scores(texts) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(scores, pa.float64())], [*keep, "score"])

    out = docs.select(*keep, utf8(text_col).alias("__text")).mapInArrow(run, spec)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
