"""Operator 2: repeated byte strings from merged Burrows-Wheeler transforms of shards.

Strings of `length` bytes that occur again are found in three steps. (1) Every window of `length` bytes has a minimizer: the
least hash among its 32-byte grams. Windows that follow one another and share it make a piece. Equal windows have equal
minimizers, so pieces whose minimizer occurs once in the corpus hold no repeat and go no further; of pieces equal as a whole
(128 bits of hash) all but the first repeat, and only the first goes on. (2) Unequal pieces with one minimizer are cut into
parts of 17 windows, which share a core of length - 16 bytes; parts whose core occurs once go, and of equal parts again only the
first goes on. (3) The parts that are left, unequal ones with a common core, dealt by core, are indexed shard by shard: each shard gets its suffix array and BWT, and the shards' BWTs are merged by
refining their interleave `length` times, which also gives the classes of equal prefixes, so no suffix is sorted again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiscope.llm.common import byte_slices, maybe_among, mix, prefix_hash, span_hash, staged
from equiscope.llm.spans import batch_firsts, by_document, numbered, outside, sha256, with_cuts

GRAM = 32
STEP = 17
MASK = (1 << 64) - 1


def minimizer_runs(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer place, first window, last window + 1) of each run of windows of one buffer; and nothing of shorter ones."""
    n = len(data) - GRAM + 1
    p = prefix_hash(data)
    at = np.arange(n, dtype=np.int64)
    v = (span_hash(p, at, at + GRAM) & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    width = length - GRAM + 1
    k = 1
    m = v
    while 2 * k <= width:
        m = np.minimum(m[:-k], m[k:])
        k *= 2
    if width > k:
        m = np.minimum(m[: len(m) - (width - k)], m[width - k :])
    place = (m & np.uint64((1 << 24) - 1)).astype(np.int64)
    starts = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    return place[starts], starts, np.append(starts[1:], len(place))


def runs_by_text(texts: list[bytes], length: int, limit: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, number of windows, minimizer hash, piece hash), the windows of long texts in several stretches."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    for i, j in byte_slices(sizes, limit):
        stretches = [(i, 0, b"".join(texts[i:j]))] if j > i + 1 or sizes[i] <= 4 * limit else [(i, k, texts[i][k : k + limit + length - 1]) for k in range(0, sizes[i] - length + 1, limit)]
        for _, base, raw in stretches:
            data = np.frombuffer(raw, np.uint8)
            if len(data) < length:
                continue
            place, a, b = minimizer_runs(data, length)
            if j > i + 1:
                ends = np.cumsum(sizes[i:j])
                text = np.searchsorted(ends, place, side="right")
                begin = ends[text] - sizes[i:j][text]
                # windows over the edge of a text don't count
                a, b = np.maximum(a, begin), np.minimum(b, ends[text] - length + 1)
                good = a < b
                place, a, b, text, begin = place[good], a[good], b[good], text[good], begin[good]
            else:
                text, begin = np.zeros(len(a), np.int64), np.full(len(a), -base)
            p = prefix_hash(data)
            yield text + i, a - begin, b - a, span_hash(p, place, place + GRAM).view(np.int64), span_hash(p, a, b + length - 1).view(np.int64), place - begin


#: a piece or part in one number: first window (36 bits), windows (7), minimizer's distance from it (7), text tag (13)
PACK_A, PACK_W, PACK_M = 27, 20, 13
MOST_LENGTH = 127 + GRAM - 1
PLACE = ("h", "ph", "doc", "at", "late")


def _pack(a: np.ndarray, w: np.ndarray, off: np.ndarray, th: np.ndarray) -> np.ndarray:
    return (a.astype(np.int64) << PACK_A) | (w.astype(np.int64) << PACK_W) | (off.astype(np.int64) << PACK_M) | th.astype(np.int64)


def placed(rows: DataFrame) -> DataFrame:
    """The packed numbers back in columns a, w, m (the minimizer's place) and th."""
    bits = lambda shift, n: F.shiftright("at", shift).bitwiseAND((1 << n) - 1).cast("int")
    a = F.shiftright("at", PACK_A)
    return rows.select("*", a.cast("int").alias("a"), bits(PACK_W, 7).alias("w"), (a + bits(PACK_M, 7)).cast("int").alias("m"), bits(0, 13).alias("th"))


def piece_rows(docs: DataFrame, length: int) -> DataFrame:
    """(h, ph, doc, at, late): the pieces of every text, packed; late are those that their batch already holds.

    Those need no more looking up. Their h is made one of their own, so that a passage in very many documents spreads out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t.as_py() for t in b.column(2)]
            found = [np.concatenate(x) for x in zip(*runs_by_text(texts, length), strict=True)]
            if not found:
                continue
            text, a, w, h, ph, m = found
            doc, th = b.column(0).to_numpy()[text], b.column(1).to_numpy()[text]
            late = ~batch_firsts(mix(h.view(np.uint64) * np.uint64(3)) ^ ph.view(np.uint64), doc, a)
            at = _pack(a, w, m - a, th)
            h = np.where(late, mix(at.view(np.uint64) ^ (doc.view(np.uint64) << np.uint64(20))).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ph), pa.array(doc), pa.array(at), pa.array(late)], list(PLACE))

    return docs.mapInArrow(run, "h long, ph long, doc long, at long, late boolean")


def settled(rows: DataFrame, *keep: str) -> DataFrame:
    """Of rows (h, ph, doc, at, late): with `again`, whether an equal one (same h and ph) comes first elsewhere, and `mixed`, whether
    its h has unequal ones too. Rows alone with their h go. One shuffle on h."""
    by_h = Window.partitionBy("h")
    rank = F.rank().over(Window.partitionBy("h", "ph").orderBy("doc", F.shiftright("at", PACK_A)))
    met = rows.withColumn("n", F.count(F.lit(1)).over(by_h)).filter("n > 1 or late")
    met = met.withColumn("again", F.col("late") | (rank > 1)).withColumn("mixed", F.min("ph").over(by_h) != F.max("ph").over(by_h))
    return met.select("h", "doc", "at", "again", "mixed", *keep)


def part_rows(docs: DataFrame, pieces: DataFrame, length: int) -> DataFrame:
    """(h, ph, doc, at, late, part): the bytes of pieces in parts of at most STEP windows; h is a hash of what all of a part's windows share."""
    wanted = staged(pieces.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "w", "m", "h")).alias("want")), "wanted")
    rows = docs.filter(maybe_among(wanted, "doc", "th")("doc", "th")).dropDuplicates(["doc", "th"]).join(wanted, ["doc", "th"]).select("doc", "th", "text", "want")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            core, whole, doc, at, to, dist, tag, part = [], [], [], [], [], [], [], []
            for d, th, t, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3).to_pylist(), strict=True):
                text = t.as_py()
                for x in want:
                    a, end, m = x["a"], x["a"] + x["w"], x["m"]
                    # cut where the distance to the minimizer is a multiple of STEP, which is the same for equal windows
                    while a < end:
                        k = (m - a) // STEP
                        stop = min(end, m - k * STEP + 1)
                        core.append(xxhash.xxh3_64_digest(text[m - k * STEP : m - (k + 1) * STEP + 1 + length], x["h"] & MASK ^ k))
                        part.append(text[a : stop + length - 1])
                        whole.append(xxhash.xxh3_64_digest(part[-1], k))
                        doc.append(d)
                        at.append(a)
                        to.append(stop)
                        dist.append(m - a)
                        tag.append(th)
                        a = stop
            if not core:
                continue
            h, ph = (np.frombuffer(b"".join(x), np.int64) for x in (core, whole))
            doc_a, a, w = np.array(doc, np.int64), np.array(at, np.int64), np.array(to, np.int64) - np.array(at, np.int64)
            late = ~batch_firsts(mix(h.view(np.uint64) * np.uint64(3)) ^ ph.view(np.uint64), doc_a, a)
            where = _pack(a, w, np.array(dist), np.array(tag))
            h = np.where(late, mix(where.view(np.uint64) ^ (doc_a.view(np.uint64) << np.uint64(20))).view(np.int64), h)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(ph), pa.array(doc_a), pa.array(where), pa.array(late), pa.array([None if x else p for x, p in zip(late, part, strict=True)], pa.binary())], [*PLACE, "part"])

    return rows.mapInArrow(run, "h long, ph long, doc long, at long, late boolean, part binary")


class Shard:
    """The suffix array of a few strings, each ended by 0 in an alphabet where byte b is b + 1, and its BWT."""

    def __init__(self, strings: list[bytes]):
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        self.ends = np.cumsum(sizes)
        flat = np.zeros(self.ends[-1], np.int64)
        body = np.ones(len(flat), bool)
        body[self.ends - 1] = False
        flat[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        n = len(flat)
        left = np.repeat(self.ends, sizes) - np.arange(n)  # places to the string's end
        rank, k = flat.copy(), 1
        while k < int(sizes.max()):
            after = np.zeros(n, np.int64)
            inside = np.flatnonzero(left > k)
            after[inside] = rank[inside + k] + 1
            key = rank * (n + 258) + after
            order = np.argsort(key, kind="stable")
            s = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.append(False, s[1:] != s[:-1]))
            k *= 2
        self.order = np.argsort(rank, kind="stable")
        before = flat[self.order - 1]
        before[np.isin(self.order, np.append(0, self.ends[:-1]))] = 0
        self.bwt = before.astype(np.int16)
        self.ended = len(strings)

    def locate(self, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(string, offset) of the suffixes of these ranks."""
        at = self.order[ranks]
        string = np.searchsorted(self.ends, at, side="right")
        return string, at - np.append(0, self.ends)[string]


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(shard of each merged row, class of each row): the interleave of the shards' BWTs refined `depth` times, rows alone in their class included."""
    shard, _, classes = interleaved(shards, depth, alone=True)
    return shard, classes


def interleaved(shards: list[Shard], depth: int, alone: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shard, rank in it, class) of each merged row; unless alone, only of those whose first `depth` symbols another row has too.

    Round k takes rows in the order of their first k - 1 symbols, reads each row's BWT symbol, and deals the rows to the symbols'
    buckets in turn, which sorts them by k symbols. Neighbours of a bucket that came from one class are one class again: they have
    k symbols in common. Rows of the end symbol are each a class of their own, so a class never reaches past a string's end. Unless
    alone, a row that is by itself goes: what is dealt from it, one symbol longer, is by itself again.
    """
    sizes = np.array([len(s.bwt) for s in shards])
    first = np.cumsum(sizes) - sizes
    bwt = np.concatenate([s.bwt for s in shards])
    # rows of a shard never change places among themselves, so where each goes is that of its shard dealt alone, for all rounds
    index = np.int32 if len(bwt) < 1 << 31 else np.int64
    step = np.empty(len(bwt), index)
    for i, n in zip(first, sizes, strict=True):
        step[i + np.argsort(bwt[i : i + n], kind="stable")] = np.arange(i, i + n)
    ended = np.concatenate([np.arange(i, i + s.ended, dtype=index) for i, s in zip(first, shards, strict=True)])
    end = bwt == 0
    # without the end symbol a byte is enough, which deals in half the time
    bwt = bwt if alone else (bwt - 1).astype(np.uint8)
    at, classes = np.arange(len(bwt), dtype=index), np.zeros(len(bwt), index)
    for _ in range(depth):
        if not alone:
            on = ~end[at]
            at, classes = at[on], classes[on]
        s = bwt[at]
        order = np.argsort(s, kind="stable")
        at, c = step[at[order]], classes[order]
        new = np.ones(len(at) + 1, bool)
        np.not_equal(c[1:], c[:-1], out=new[1:-1])
        new[np.cumsum(np.bincount(s, minlength=256))] = True
        if alone:
            at[: len(ended)] = ended
            new[: len(ended)] = True
            classes = np.cumsum(new[:-1], dtype=index)
        else:
            on = ~(new[:-1] & new[1:])
            at, classes = at[on], np.cumsum(new[:-1][on], dtype=index)
        if not len(at) or new.all():
            break
    shard = np.searchsorted(first, at, side="right") - 1
    return shard, at - first[shard], classes


def repeats(parts: list[tuple[int, int, int, bytes]], length: int, shard_bytes: int = 1 << 17) -> list[tuple[int, int, int, int]]:
    """(doc, th, first byte, end) of every window of the parts that also starts earlier in one of them."""
    sizes = np.array([len(p[3]) for p in parts])
    cuts = list(byte_slices(sizes, max(shard_bytes, int(sizes.sum()) // 200)))
    shards = [Shard([p[3] for p in parts[i:j]]) for i, j in cuts]
    z, rank, classes = interleaved(shards, length)
    if not len(z):
        return []
    string, offset = np.empty(len(z), np.int64), np.empty(len(z), np.int64)
    for k, (shard, (i, _)) in enumerate(zip(shards, cuts, strict=True)):
        here = z == k
        string[here], offset[here] = shard.locate(rank[here])
        string[here] += i
    doc = np.array([p[0] for p in parts], np.int64)[string]
    start = np.array([p[2] for p in parts], np.int64)[string] + offset
    whole = sizes[string] - offset >= length
    doc, start, string, cls = doc[whole], start[whole], string[whole], classes[whole]
    late = ~batch_firsts(cls, doc, start)
    return [(parts[s][0], parts[s][1], int(x), int(x) + length) for s, x in zip(string[late], start[late], strict=True)]


def later_windows(parts: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(doc, th, s, e) from parts dealt and sorted by core; a block ends where a core ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            found = repeats(block, length)
            cols = list(zip(*found, strict=True)) if found else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "th", "s", "e"])

        block: list[tuple[int, int, int, bytes]] = []
        held, last = 0, None
        for b in batches:
            for core, doc, th, a, part in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held > block_bytes and core != last:
                    yield done()
                    block, held = [], 0
                block.append((doc, th, a, part))
                held += len(part)
                last = core
        if block:
            yield done()

    return parts.mapInArrow(run, "doc long, th int, s int, e int")


def repeated_strings(docs: DataFrame, length: int, crowd: int, block_bytes: int) -> DataFrame:
    """(doc, th, s, e): stretches of (doc, th, text) rows whose windows all start earlier too."""
    spans = lambda rows: placed(rows.select("doc", "at")).select("doc", "th", F.col("a").alias("s"), (F.col("a") + F.col("w") + (length - 1)).alias("e"))
    pieces = staged(settled(piece_rows(docs, length)), "pieces")
    parts = part_rows(docs, placed(pieces.filter("mixed and not again")), length)
    parts = staged(settled(parts, "part").filter("again or mixed"), "parts")
    whole = spans(pieces.filter("again").unionByName(parts.filter("again").drop("part"), allowMissingColumns=True))
    parts = placed(parts.filter("mixed and not again")).withColumnRenamed("h", "core")
    crowds = parts.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("core", F.lit(True).alias("crowded"))
    parts = staged(parts.join(crowds, "core", "left").select("core", "doc", "th", "a", "part", "crowded"), "cores")
    few = parts.filter("crowded is null").select("core", "doc", "th", "a", "part")
    late = later_windows(few.repartition("core").sortWithinPartitions("core"), length, block_bytes)
    # of a core that very many parts share, each window is a class of its own; nothing is gathered
    windows = parts.filter("crowded").select("doc", "th", "a", F.explode(F.expr(f"transform(sequence(0, octet_length(part) - {length}), i -> struct(i, substring(part, i + 1, {length}) as w))")).alias("x"))
    windows = windows.select("doc", "th", (F.col("a") + F.col("x.i")).alias("s"), F.sha2("x.w", 256).alias("w"))
    first = windows.groupBy("w").agg(F.min(F.struct("doc", "s")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    crowded = windows.join(first, "w").filter(F.struct("doc", "s") != F.col("first")).select("doc", "th", "s", (F.col("s") + length).alias("e"))
    return whole.unionByName(late).unionByName(crowded)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, length: int = 100, crowd: int = 5000, block_bytes: int = 1 << 21, keep_text: bool = False) -> DataFrame:
    """Per row: id, n_bytes, n_removed, n_spans, kept_sha256; with keep_text also kept_text.

    A byte goes when a string of `length` bytes that covers it also starts earlier (smaller id, or earlier in the same text);
    strings overlap, lie within one text and are judged on the input. A null text is empty; a null id counts as the smallest;
    repeated rows (equal id and text) are one document, and each gives the same row; an empty table gives none; other columns
    are not read. length is 64 to 158, as a piece's number of windows is kept in 7 bits.
    """
    if not 2 * GRAM <= length <= MOST_LENGTH:
        raise ValueError(f"length {length}: from {2 * GRAM} to {MOST_LENGTH}")
    cuts = by_document(repeated_strings(numbered(docs, id_col, text_col), length, crowd, block_bytes))

    def make(text: bytes, cut: list[tuple[int, int]]) -> tuple:
        kept = outside(text, cut)
        return len(text), len(text) - len(kept), len(cut), sha256(kept), kept.decode("utf-8", "replace") if keep_text else None

    long_, text_ = pa.int64(), pa.string()
    out = with_cuts(docs, cuts, make, id_col, text_col, "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string", [long_] * 3 + [text_] * 2)
    return out if keep_text else out.drop("kept_text")
