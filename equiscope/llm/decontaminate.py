"""Operator 9: benchmark decontamination with a generalised suffix automaton over item words."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiscope.llm.common import staged, utf8

#: A-Z to a-z; 0-9, a-z and every byte of a non-ASCII character are word bytes; all else is a blank.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(NORMAL).split()


class ItemAutomaton:
    """The generalised suffix automaton of the items' words, with what a stream needs to know at each state."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int):
        self.window, self.ids = window, [i for i, _ in items]
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        runs = [[self.vocab.setdefault(w, len(self.vocab)) for w in ws] for _, ws in items]
        for run in runs:
            last = 0
            for c in run:
                last = self._extend(last, c)
        n = len(self.len)
        #: state at which the last `window` words of the state's strings live, or -1
        self.top = [-1] * n
        for v in sorted(range(1, n), key=self.len.__getitem__):
            if self.len[v] >= window:
                self.top[v] = v if self.len[self.link[v]] < window else self.top[self.link[v]]
        #: items that hold the state's `window` words; short items that end at a state, with their length
        self.holds: list[set[int]] = [set() for _ in range(n)]
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for k, run in enumerate(runs):
            v = 0
            for c in run:
                v = self.next[v][c]
                if self.top[v] >= 0:
                    self.holds[self.top[v]].add(k)
            if 0 < len(run) < window:
                self.ends[v].append((len(run), k))
        #: nearest state on the suffix path, itself included, at which a short item ends
        self.short = [-1] * n
        for v in sorted(range(1, n), key=self.len.__getitem__):
            self.short[v] = v if self.ends[v] else self.short[self.link[v]] if self.link[v] > 0 else -1

    def _new(self, length: int, link: int, trans: dict[int, int]) -> int:
        self.len.append(length)
        self.link.append(link)
        self.next.append(trans)
        return len(self.len) - 1

    def _split(self, p: int, c: int) -> int:
        """The state of the longest string at p followed by c, parted from longer ones where needed."""
        q = self.next[p][c]
        if self.len[q] == self.len[p] + 1:
            return q
        r = self._new(self.len[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c)
        new = self._new(self.len[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c)
        return new

    def match(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit spans of word positions, merged, and the items (their places in the list) with occurring windows."""
        spans: list[tuple[int, int]] = []
        found: set[int] = set()
        nxt, link, length, top, short, window = self.next, self.link, self.len, self.top, self.short, self.window
        v = at = 0  # the state, and how many of the last words it matches
        for i, c in enumerate(map(self.vocab.get, ws)):
            if c is None:
                v = at = 0
                continue
            while v and c not in nxt[v]:
                v = link[v]
                at = length[v]
            if c not in nxt[v]:
                continue
            v = nxt[v][c]
            at += 1
            start = i + 1
            if at >= window:
                start = i + 1 - window
                found |= self.holds[top[v]]
            u = short[v]
            while u > 0:
                for n, k in self.ends[u]:
                    if n <= at:
                        found.add(k)
                        start = min(start, i + 1 - n)
                u = short[link[u]] if link[u] > 0 else -1
            if start <= i:
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def shard_count(bench: DataFrame, text_col: str, most_words: int) -> int:
    n_words = F.coalesce(F.length(text_col), F.lit(0)) / 2  # no text has more words than half its characters, and one
    total = bench.agg(F.sum(n_words + 1).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // most_words))


def automaton(bench: DataFrame, shard: int, shards: int, window: int, id_col: str, text_col: str) -> ItemAutomaton:
    """The automaton of one shard of the items, about most_words words, which bounds what the driver holds and sends."""
    part = bench.filter(F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col), F.lit(shards)) == shard)
    part = part.select(F.col(id_col).cast("string").alias("i"), utf8(text_col).alias("t")).orderBy("i", "t")
    return ItemAutomaton([(r["i"], w) for r in part.toLocalIterator() if (w := words(bytes(r["t"])))], window)


def _found(m: ItemAutomaton, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[str | None]]:
    spans, found = m.match(ws)
    return spans, {m.ids[k] for k in found}


def hits_by_text(docs: DataFrame, bench: DataFrame, shards: int, window: int, item_id: str, item_text: str) -> DataFrame:
    """(key, spans, items): what the items of all shards hit in each text that they hit, by a 128-bit hash of it.

    The documents pass one automaton after the other, so that no worker ever holds two.
    """
    spark, out = docs.sparkSession, None
    for k in range(shards):
        machine = spark.sparkContext.broadcast(automaton(bench, k, shards, window, item_id, item_text))

        def scan(batches: Iterator[pa.RecordBatch], machine=machine) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rows = []
                for raw in b.column(0):
                    text = raw.as_py()
                    spans, items = _found(machine.value, words(text))
                    if spans:
                        rows.append((xxhash.xxh3_128_digest(text), [x for s in merged(spans) for x in s], sorted(items - {None}), None in items))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
                kinds = (pa.binary(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["key", "spans", "items", "unnamed"])

        one = docs.select("_text").mapInArrow(scan, "key binary, spans array<int>, items array<string>, unnamed boolean")
        one = staged(one.dropDuplicates(["key"]), "hits")
        machine.unpersist()
        out = one if out is None else out.unionByName(one)
    # a text has a row for each shard at most
    g = out.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.max("unnamed").alias("unnamed"))
    return g


def contamination(
    docs: DataFrame, bench: DataFrame, window: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", *, most_words: int = 200_000, keep_text: bool = False
) -> DataFrame:
    """Per row: id, n_words, n_hit, n_items, items_sha256, contaminated; with keep_text also clean_text.

    Words: A-Z lower-cased, runs of letters, digits and non-ASCII bytes. A window is `window` consecutive words of an item,
    or a whole shorter item. Every word inside an occurrence of a window is hit; a document is contaminated when it has hits
    and they are at least `share` of its words. clean_text is the text without the hit spans (from the first hit word's first
    byte to the last one's last). The documents are streamed past a broadcast automaton of at most about most_words words (160 MB of
    objects for 200,000), without a shuffle; a larger benchmark is dealt to several, which the documents pass one after the other,
    and what they hit is joined by text. A null or wordless text has 0 words and is not contaminated; items without words match nothing;
    equal item ids count once, null ones too, which hit and count in n_items but are not in the list that is hashed; an empty benchmark hits nothing; repeated rows each give a row.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shards = shard_count(bench, item_text, most_words)
    rows = docs.select(F.col(id_col), utf8(text_col).alias("_text"))

    def made(text: bytes, ws: list[bytes], hit: list[tuple[int, int]], items: set[str | None]) -> tuple:
        n_hit = sum(e - s for s, e in hit)
        digest = hashlib.sha256(",".join(sorted(items - {None})).encode()).hexdigest()
        return len(ws), n_hit, len(items), digest, n_hit > 0 and n_hit >= share * len(ws) - 1e-9, without(text, hit).decode("utf-8", "replace") if keep_text else None

    def batch(ids: pa.Array, out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "clean_text"])

    shape = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, clean_text string"
    if shards == 1:
        machine = docs.sparkSession.sparkContext.broadcast(automaton(bench, 0, 1, window, item_id, item_text))

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for raw in b.column(1):
                    text = raw.as_py()
                    ws = words(text)
                    spans, items = _found(machine.value, ws)
                    out.append(made(text, ws, merged(spans), items))
                yield batch(b.column(0), out)

        out = rows.mapInArrow(scan, shape)
    else:
        hits = hits_by_text(rows, bench, shards, window, item_id, item_text)

        @F.pandas_udf("binary")
        def key(texts: pd.Series) -> pd.Series:
            return texts.map(lambda t: xxhash.xxh3_128_digest(bytes(t)))

        def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for raw, spans, items, unnamed in zip(b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                    text, flat = raw.as_py(), spans or []
                    out.append(made(text, words(text), merged(list(zip(flat[::2], flat[1::2], strict=True))), set(items or ()) | ({None} if unnamed else set())))
                yield batch(b.column(0), out)

        out = rows.withColumn("key", key("_text")).join(hits, "key", "left").select(id_col, "_text", "spans", "items", "unnamed").mapInArrow(joined, shape)
    return out if keep_text else out.drop("clean_text")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def without(text: bytes, hit: list[tuple[int, int]]) -> bytes:
    """The text less the bytes of the hit word spans."""
    if not hit:
        return text
    flat, places, i = text.translate(NORMAL), [], 0
    n = len(flat)
    while i < n:
        if flat[i] == 32:
            i += 1
            continue
        j = flat.find(b" ", i)
        j = n if j < 0 else j
        places.append((i, j))
        i = j
    out, i = [], 0
    for s, e in hit:
        out.append(text[i : places[s][0]])
        i = places[e - 1][1]
    return b"".join([*out, text[i:]])
